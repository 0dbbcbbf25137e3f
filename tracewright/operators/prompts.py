"""Prompt antipatterns and quality of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import vocab as V
from tracewright.functions.scalars import round3
from tracewright.functions.text import ask_count, count_where, jaccard, let, listed, matches, trim, word_set, words


def likeness_to_first(prompts: Column) -> Column:
    """Of each later prompt its Jaccard similarity to the first."""
    return let(F.transform(prompts, lambda p: word_set(p)), lambda sets: F.transform(F.slice(sets, F.lit(2), F.greatest(F.size(sets) - 1, F.lit(0))), lambda w: jaccard(F.get(sets, F.lit(0)), w)))


def prompt_quality(sessions: DataFrame) -> DataFrame:
    """Sessions with prompt_antipatterns and prompt_quality; [] and 0.5 where the first prompt is missing or blank."""
    c = F.col
    first = F.coalesce(F.try_element_at("prompt_texts", F.lit(1)), F.lit(""))
    s = sessions.withColumns({"first_prompt": first, "later": F.filter("prompt_texts", lambda _, i: i > 0), "likeness": likeness_to_first(c("prompt_texts"))})
    calls = F.transform("tool_calls", lambda t: t["name"])
    edits = F.transform(calls, lambda n: n.isin(*V.EDIT_TOOLS))
    before = F.slice(calls, F.lit(1), F.when(F.array_position(edits, F.lit(True)) > 0, (F.array_position(edits, F.lit(True)) - 1).cast("int")).otherwise(F.size(calls)))
    s = s.withColumns({"first_words": F.size(words("first_prompt")), "task_like": matches("first_prompt", V.IMPERATIVE), "concrete": matches("first_prompt", V.CONCRETE), "pre_edit_searches": count_where(before, lambda n: n.isin(*V.SEARCH_TOOLS))})
    s = s.withColumns({
        "corrections": count_where("later", lambda p: matches(trim(p), V.CORRECTIVE)),
        "new_asks": count_where(F.arrays_zip("later", "likeness"), lambda x: ~matches(trim(x["later"]), V.CORRECTIVE) & (F.size(words(x["later"])) >= 5) & matches(x["later"], V.IMPERATIVE) & (x["likeness"] < 0.15)),
    })
    found = listed([
        ((c("first_words") < 8) & ~c("concrete") & ~c("is_continuation"), "vague_goal"),
        (c("task_like") & (c("first_words") >= 5) & ~matches("first_prompt", V.CRITERIA), "no_success_criteria"),
        (c("task_like") & ~c("concrete") & (c("pre_edit_searches") >= 6), "missing_context"),
        (c("corrections") >= 2, "correction_loop"),
        (c("new_asks") >= 2, "scope_creep"),
        ((ask_count("first_prompt") >= 3) & (c("first_words") > 60), "kitchen_sink"),
    ])
    s = s.withColumn("prompt_antipatterns", F.when(trim("first_prompt") == "", F.array().cast("array<string>")).otherwise(found))
    weight = F.lit(1.0)
    for name, w in V.ANTIPATTERN_WEIGHTS.items():
        weight = weight - F.when(F.array_contains("prompt_antipatterns", name), w).otherwise(0.0)
    quality = F.when(trim("first_prompt") == "", 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), round3(weight))))
    return s.withColumn("prompt_quality", quality).drop("first_prompt", "later", "likeness", "first_words", "task_like", "concrete")


def advice(antipattern: str) -> str | None:
    return V.ANTIPATTERN_ADVICE.get(antipattern)


def with_advice(df: DataFrame, antipattern: str = "antipattern") -> DataFrame:
    table = df.sparkSession.createDataFrame(list(V.ANTIPATTERN_ADVICE.items()), f"{antipattern} string, advice string")
    return df.join(F.broadcast(table), antipattern, "left")  # six rows

"""Functions of numbers, names, paths and times, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions import vocab as V
from tracewright.functions.text import Text, col, first_case, matches

MAX_INT = (1 << 53) - 1


def _finite(x: Column) -> Column:
    d = x.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | d.isin(float("inf"), float("-inf")), None).otherwise(d)


def round3(x: Column) -> Column:
    """Half up, as floor(1000 x + 0.5) / 1000."""
    return F.floor(x * 1000 + 0.5) / 1000


def round_micro(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5) / 1e6


def clamp01(x: Text) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(_finite(col(x)), F.lit(0.0))))


def clamp_int(x: Text, most: int = MAX_INT) -> Column:
    v = F.coalesce(_finite(col(x)), F.lit(0.0))
    return F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.floor(F.least(v, F.lit(float(MAX_INT))) + 0.5))).cast("long")


def non_negative(x: Text) -> Column:
    """To a millionth; 0 if not a positive finite number."""
    v = F.coalesce(_finite(col(x)), F.lit(0.0))
    return F.when(v > 0, round_micro(v)).otherwise(0.0)


def iso_minute(x: Text) -> Column:
    """A timestamp of an ISO text, cut to the minute in UTC; null if it is none."""
    return F.date_trunc("MINUTE", F.try_to_timestamp(F.when(matches(x, r"^[+-]?\d{4,6}-\d{2}"), col(x))))


def iso_text(ts: Text) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def region_of(tool: Text) -> Column:
    return first_case([(col(tool).isin(*tools), F.lit(region)) for region, tools in V.TOOL_REGION.items()], V.OTHER_REGION)


def price_in(model: Text) -> Column:
    return first_case([(F.lower(F.coalesce(col(model), F.lit(""))).rlike(p), F.lit(float(i))) for p, i, _ in V.MODEL_PRICES], float(V.DEFAULT_PRICE[0]))


def price_out(model: Text) -> Column:
    return first_case([(F.lower(F.coalesce(col(model), F.lit(""))).rlike(p), F.lit(float(o))) for p, _, o in V.MODEL_PRICES], float(V.DEFAULT_PRICE[1]))


def estimate_cost(model: Text, tokens_in: Text, tokens_out: Text, cache_read: Text, cache_creation: Text) -> Column:
    p, q = price_in(model), price_out(model)
    usd = (col(tokens_in) * p + col(cache_creation) * p * 1.25 + col(cache_read) * p * 0.10 + col(tokens_out) * q) / 1e6
    return F.greatest(F.lit(0.0), round_micro(usd))


def cost_without_cache(model: Text, tokens_in: Text, tokens_out: Text, cache_read: Text, cache_creation: Text) -> Column:
    i, o, r, c = (F.coalesce(_finite(col(x)), F.lit(0.0)) for x in (tokens_in, tokens_out, cache_read, cache_creation))
    return F.greatest(F.lit(0.0), round_micro(((i + c + r) * price_in(model) + o * price_out(model)) / 1e6))


def extension(path: Text) -> Column:
    return F.lower(F.element_at(F.split(F.coalesce(col(path), F.lit("")), "\\."), -1))


def domain_of_extensions(has_any) -> Column:
    """has_any(extensions) -> whether any file has one of them."""
    return first_case([(has_any(exts), F.lit(name)) for name, exts in V.DOMAIN_EXTENSIONS], "other")


def short_path(path: Text, home: str = "/root") -> Column:
    p = F.coalesce(col(path), F.lit(""))
    at = F.instr(p, home)
    p = F.when(at > 0, F.concat(F.substring(p, F.lit(1), at - 1), F.lit("~"), F.substring(p, at + len(home), F.length(p)))).otherwise(p)
    parts = F.filter(F.split(p, r"[/\\]"), lambda s: s != "")
    return F.when(F.size(parts) > 3, F.concat(F.lit("…/"), F.array_join(F.slice(parts, F.size(parts) - 1, F.lit(2)), "/"))).otherwise(p)


def project_name(relative_path: Text) -> Column:
    """From a path below the transcripts' folder: its first segment and, if that encodes a path with dashes, the last part of it."""
    first = F.coalesce(F.nullif(F.element_at(F.split(col(relative_path), "/"), 1), F.lit("")), F.lit("unknown"))
    parts = F.filter(F.split(first, "-"), lambda s: (s != "") & ~s.isin("Users", "home", "mnt", "c", "C"))
    return F.when(F.contains(first, F.lit("-")) & (F.size(parts) > 0), F.try_element_at(parts, F.lit(-1))).otherwise(first)


def general_tool(name: Text) -> Column:
    """A tool's name in prompts: built-in names, mcp, other."""
    n = col(name)
    return F.when(n.isNull() | (n == ""), "other").when(n.startswith("mcp__"), "mcp").when(n.isin(*V.BUILTIN_TOOLS), n).otherwise("other")


def ship_label(raw: Text, salt: str | None, assigned: Text | None = None) -> Column:
    from tracewright.functions.text import hmac12, sanitize_label

    if not salt:
        return sanitize_label(raw)
    own = sanitize_label(assigned) if assigned is not None else F.lit("")
    return F.coalesce(F.nullif(own, F.lit("")), F.concat(F.lit("p-"), hmac12(salt, raw)))


def describe_tool(name: Text, field) -> Column:
    """One line about a tool call. field(key) -> the input's string under a key, null if there is none."""
    n, text = col(name), lambda k: F.coalesce(field(k), F.lit(""))
    host = F.try_parse_url(field("url"), F.lit("HOST"))
    said = F.coalesce(F.nullif(text("description"), F.lit("")), F.nullif(text("subagent_type"), F.lit("")), F.lit("task"))
    parts = F.split(n, "__")
    return (
        F.when(n == "Read", F.concat(F.lit("Reading "), short_path(text("file_path"))))
        .when(n == "Write", F.concat(F.lit("Writing "), short_path(text("file_path"))))
        .when(n.isin("Edit", "MultiEdit"), F.concat(F.lit("Editing "), short_path(text("file_path"))))
        .when(n == "NotebookEdit", F.concat(F.lit("Notebook edit "), short_path(text("notebook_path"))))
        .when(n == "Glob", F.concat(F.lit("Glob "), text("pattern")))
        .when(n == "Grep", F.concat(F.lit('Grep "'), F.left(text("pattern"), F.lit(28)), F.lit('"')))
        .when(n == "LS", F.concat(F.lit("Listing "), short_path(text("path"))))
        .when(n == "Bash", F.concat(F.lit("$ "), F.left(text("command"), F.lit(48))))
        .when(n == "BashOutput", "Reading shell output")
        .when(n == "WebSearch", F.concat(F.lit("Searching: "), F.left(text("query"), F.lit(40))))
        .when(n == "WebFetch", F.coalesce(F.concat(F.lit("Fetching "), host), F.lit("Web fetch")))
        .when(n == "Task", F.concat(F.lit("Subagent: "), F.left(said, F.lit(40))))
        .when(n == "TodoWrite", "Updating todo list")
        .when(n == "ExitPlanMode", "Exiting plan mode")
        .when(n.startswith("mcp__"), F.concat(F.lit("MCP · "), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "/")))
        .otherwise(F.coalesce(F.nullif(n, F.lit("")), F.lit("tool")))
    )


def block_tokens(output_tokens: Text, blocks: Text) -> Column:
    """Tokens of each counted block of a message."""
    n = col(blocks)
    return F.when(n > 0, F.greatest(F.lit(5), F.ceil(F.coalesce(col(output_tokens), F.lit(0)) / n))).otherwise(10).cast("long")


def text_tokens(x: Text, chars: int = 4, least: int = 5) -> Column:
    return F.greatest(F.lit(least), F.ceil(F.length(col(x)) / chars)).cast("long")

"""Sharing tiers: resolution by precedence, failing closed, and what each tier ships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import vocab as V
from tracewright.functions.text import Text, col


def normalized(name: Text) -> Column:
    """A tier's name whatever its case, else null."""
    return F.when(F.lower(col(name)).isin(*V.TIERS), F.lower(col(name)))


def legacy_tier(sharing: Text, usage: Text) -> Column:
    """The tier that the two older settings stand for; null if neither is set. Never less than presence."""
    level = F.when(col(sharing).isin("full", "tool", "region"), col(sharing)).otherwise("full")
    tier = F.when(level != "full", "presence").when(F.coalesce(col(usage) != "0", F.lit(True)), "full").otherwise("activity")
    return F.when(col(sharing).isNotNull() | col(usage).isNotNull(), tier)


def resolve(settings: DataFrame, env: str = "env_tier", env_old: str = "env_tier_old", cfg: str = "cfg_tier", sharing: str = "legacy_sharing", usage: str = "legacy_usage") -> DataFrame:
    """settings with tier, source, live, usage, facts and warning. A name that is given but wrong means off."""
    given = F.coalesce(env, env_old)
    old = legacy_tier(sharing, usage)
    tier = F.when(given.isNotNull(), F.coalesce(normalized(given), F.lit("off"))).when(F.col(cfg).isNotNull(), F.coalesce(normalized(cfg), F.lit("off"))).when(old.isNotNull(), old).otherwise(V.DEFAULT_TIER)
    source = (
        F.when(given.isNotNull(), F.when(normalized(given).isNotNull(), "env").otherwise("invalid-env")).when(F.col(cfg).isNotNull(), F.when(normalized(cfg).isNotNull(), "config").otherwise("invalid-config"))
        .when(old.isNotNull(), "legacy-env").otherwise("default")
    )
    out = settings.withColumns({"tier": tier, "source": source})
    wrong = F.concat(F.lit('"'), F.coalesce(given, F.col(cfg)), F.lit('" is not a valid tier: nothing is shared. Valid tiers: ' + ", ".join(V.TIERS)))
    warning = F.when(F.col("source").startswith("invalid"), wrong).when(F.col("source") == "legacy-env", F.concat(F.lit("older settings stand for tier "), F.col("tier")))
    return out.withColumns(flags("tier") | {"warning": warning})


def flags(tier: Text) -> dict[str, Column]:
    """live, usage, facts of a tier."""
    c = col(tier)
    live = F.when(c == "presence", "region").when(c != "off", "full")
    return {"live": live, "usage": c.isin(*(n for n, t in V.TIERS.items() if t[1])), "facts": c.isin(*(n for n, t in V.TIERS.items() if t[2]))}


def describe(tier: Text) -> Column:
    out = None
    for name, (*_, meaning) in V.TIERS.items():
        out = F.when(col(tier) == name, meaning) if out is None else out.when(col(tier) == name, meaning)
    return out.otherwise(V.TIERS[V.DEFAULT_TIER][3])


def strip_facts(df: DataFrame, facts: str, ship: Text) -> DataFrame:
    return df.withColumn(facts, F.when(col(ship), F.col(facts)).otherwise(F.array().cast(df.schema[facts].dataType)))

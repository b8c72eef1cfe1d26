"""Names resolved through ordered alternatives: several spellings of a name, several registries, the first that knows one wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import scalars
from quarrystone.operators.storage import small_side


def spellings(name: Column) -> Column:
    """The name, the name in lower case, its slug, its slug in lower case, each once, in this order."""
    slug = scalars.run_slug(name)
    return F.array_distinct(F.array(name, F.lower(name), slug, F.lower(slug)))


def resolved(requests: DataFrame, name: str, registries: list[DataFrame], key: str, spec: str, variants=spellings) -> DataFrame:
    """requests with spec, registry (number of the one that knew it), variant (number of the spelling) and matched (the spelling).

    Earlier registries come before later ones whatever the spelling, within one the earlier spelling counts; a registry that holds a
    key twice gives the smaller spec. What nobody knows has nulls, null names as well. All alternatives meet in one join of the different
    names, whose best row is the least by (registry, variant): nothing is looked up again for names that repeat.
    """
    parts = [r.select(F.lit(k).alias("registry"), F.col(key).cast("string").alias("matched"), F.col(spec).alias("spec")) for k, r in enumerate(registries)]
    known = reduce(DataFrame.unionByName, parts).where("matched is not null and spec is not null")
    names = requests.select(F.col(name).alias("__name")).where("__name is not null").distinct()
    asked = names.select("__name", F.posexplode(variants(F.col("__name"))).alias("variant", "matched")).where("matched is not null")
    hits = asked.join(known, "matched")
    best = hits.groupBy("__name").agg(F.min(F.struct("registry", "variant", "spec", "matched")).alias("b"))
    found = small_side(best.select("__name", "b.spec", "b.registry", "b.variant", "b.matched"))
    return requests.join(found, F.col(name) == F.col("__name"), "left").drop("__name")

"""Names of a table looked up inside texts, all at once by an Aho-Corasick automaton."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of one automaton (some 20 MB in a worker); a longer table is cut into several, each asked in turn.
MOST_NAMES = 200_000


def _ranks(names: list[tuple[int, str]], spark):
    """A column function: the smallest rank of the names inside a text, NULL if none is there."""
    held = spark.sparkContext.broadcast(names)
    built = {}

    @F.pandas_udf("long")
    def look(texts):
        import ahocorasick
        import pandas as pd

        if "tree" not in built:  # once per worker and batch sequence
            tree = ahocorasick.Automaton()
            for rank, name in held.value:
                # The first of equal names counts.
                if not tree.exists(name) or tree.get(name) > rank:
                    tree.add_word(name, rank)
            tree.make_automaton()
            built["tree"] = tree
        tree = built["tree"]
        out = []
        for text in texts:
            found = None
            if text:
                for _, rank in tree.iter(text):
                    if found is None or rank < found:
                        found = rank
            out.append(found)
        return pd.Series(out, dtype="Int64")

    return look


def first_named(texts: DataFrame, names: DataFrame, text: str = "place", key: str = "key", rank: str = "rank", most: int = MOST_NAMES) -> DataFrame:
    """Add ``name_rank``: of the names that stand in the text, in any case, the rank of the one that comes first in the table.

    ``names``: ``key`` and a whole ``rank``.  Names of the automata reach the driver and workers, ``most`` at a time; texts are never
    joined with names.  Names and texts that are NULL or empty match nothing; a name matches inside words too; repeated names count
    by their smallest rank; without names nothing is found.
    """
    known = names.select(F.col(rank).cast("long").alias("rank"), F.lower(F.col(key)).alias("name")).filter("name <> '' AND rank IS NOT NULL")
    parts = -(-known.count() // most)
    low = F.lower(F.trim(F.col(text)))
    if not parts:
        return texts.withColumn("name_rank", F.lit(None).cast("long"))
    found = []
    for i in range(parts):
        rows = known.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == i).collect()
        if rows:
            found.append(_ranks([(r["rank"], r["name"]) for r in rows], texts.sparkSession)(low))
    return texts.withColumn("name_rank", found[0] if len(found) == 1 else F.least(*found))

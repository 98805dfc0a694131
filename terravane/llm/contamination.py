"""Held-out probe texts inside alert texts: a prefix-filtered set join with exact windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.texts import KEY, row_key, stage, text_of, word_count, words

WINDOW = 13
# Up to this many distinct windows (about 60 MB of words) the probe side is broadcast, beyond it shuffled.
BROADCAST_WINDOWS = 200_000
# Up to this many keys of rejected alerts (16 MB) are broadcast.
BROADCAST_KEYS = 1_000_000


def probe_windows(probes: DataFrame, window: int = WINDOW, probe_id: str = "probe_id", description: str = "description") -> DataFrame:
    """``probe_id, win``: every run of ``window`` words; a probe of fewer words, but not none, is one run."""
    listed = probes.select(F.col(probe_id).alias("probe_id"), words(text_of(description)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    return listed.select("probe_id", "w", F.explode(starts).alias("s")).select(
        "probe_id", F.slice("w", F.col("s"), F.lit(window)).alias("win")).distinct()


def _hits(texts: DataFrame, grams: DataFrame, window: int, small: bool) -> DataFrame:
    """``_k1, _k2, start, win``: the places of ``texts(_k1, _k2, w)`` where a window stands.

    Each window is looked up by its rarest word only (the prefix that containment of all words needs).
    Bounds on position and length and the second rarest word come before the comparison of all words.
    """
    at = texts.select(*KEY, "w", F.posexplode("w").alias("pos", "word"))
    first = F.col("pos") - F.col("off1")
    fits = (first >= 0) & (first + F.col("len") <= F.size("w"))
    if small:
        return at.join(
            F.broadcast(grams), (F.col("word") == F.col("word1")) & fits
            & (F.get("w", first + F.col("off2")) == F.col("word2")) & (F.slice("w", first + 1, F.col("len")) == F.col("win")),
        ).select(*KEY, first.alias("start"), "win")
    # The probe side is large: send each word with its neighbourhood, never the whole text.
    low = F.greatest(F.col("pos") - F.lit(window - 1), F.lit(0))
    near = at.select(*KEY, "pos", "word", low.alias("low"), F.slice("w", low + 1, F.lit(2 * window - 1)).alias("near"))
    from_low = first - F.col("low")
    return near.join(
        grams, (F.col("word") == F.col("word1")) & (first >= F.col("low")) & (from_low + F.col("len") <= F.size("near"))
        & (F.get("near", from_low + F.col("off2")) == F.col("word2")) & (F.slice("near", from_low + 1, F.col("len")) == F.col("win")),
    ).select(*KEY, first.alias("start"), "win")


def _covered(spans: Column) -> Column:
    """Number of positions that sorted (start, stop) spans cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["end"]), F.lit(0).cast("long"))).alias("n"),
        F.greatest(a["end"], s["stop"]).alias("end"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def contaminated(share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def keep_uncontaminated(alerts: DataFrame, probes: DataFrame, alert_id: str = "alert_id", text: str = "description") -> DataFrame:
    """The alerts that are not contaminated, all columns as they are; only the keys of the others are joined back."""
    hits = probe_hits(alerts.select(F.col(alert_id).alias("alert_id"), F.col(text).alias("description")), probes)
    bad = stage(hits.filter(contaminated()).select(*row_key("alert_id", "description")).distinct(), "contaminated")
    few = bad.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    k1, k2 = row_key(alert_id, text)
    return alerts.join(F.broadcast(bad) if few else bad, (k1 == F.col("_k1")) & (k2 == F.col("_k2")), "left_anti")


def probe_hits(
    alerts: DataFrame, probes: DataFrame, window: int = WINDOW, alert_id: str = "alert_id", probe_id: str = "probe_id",
    description: str = "description", broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Which words of each alert stand inside a window of a probe.

    Returns one row per row of ``alerts``: ``alert_id, description, n_words, n_hit, probe_ids, spans``; ``probe_ids`` are
    the probes with a window in the text, sorted as strings, ``spans`` the word positions [start, stop) of the windows.
    Words: A-Z lower-cased, runs of letters, digits and anything beyond ASCII.  A NULL or empty text has no
    words and no hits; a probe without words has no windows; equal probes are all named; repeated alerts get
    equal rows; empty tables give no hits; other columns are ignored.

    Two passes over the texts: frequency of the probes' words over all alerts, then the join on the
    rarest word of each window.  Up to ``broadcast_windows`` windows nothing but hits is shuffled.
    """
    base = alerts.select(F.col(alert_id).alias("alert_id"), F.col(description).alias("description"))
    texts = base.select(*row_key("alert_id", "description"), words(text_of("description")).alias("w"))
    owned = stage(probe_windows(probes, window, probe_id, description), "windows")
    grams = owned.select("win").distinct()
    small = grams.limit(broadcast_windows + 1).count() <= broadcast_windows
    placed = grams.select("win", F.posexplode("win").alias("off", "word"))
    vocabulary = placed.select("word").distinct()
    seen = texts.select(F.explode("w").alias("word")).join(F.broadcast(vocabulary) if small else vocabulary, "word")
    counts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # A word that no alert has rules its windows out.  At most ``window`` words meet in a group.
    ranked = placed.join(counts, "word", "left").groupBy("win").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "off"))).alias("r"))
    at = lambda i: F.get("r", F.least(F.lit(i), F.size("r") - 1))
    grams = stage(ranked.filter(at(0)["n"] > 0).select(
        "win", F.size("win").alias("len"), at(0)["word"].alias("word1"), at(0)["off"].alias("off1"),
        at(1)["word"].alias("word2"), at(1)["off"].alias("off2")), "grams")
    hits = stage(_hits(texts, grams, window, small).distinct(), "hits")
    spans = hits.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct(
        F.col("start").cast("long").alias("start"), (F.col("start") + F.size("win")).cast("long").alias("stop")))).alias("spans"))
    named = hits.select(*KEY, "win").distinct().join(owned, "win").groupBy(*KEY).agg(
        F.array_sort(F.collect_set(F.col("probe_id").cast("string"))).alias("probe_ids"))
    found = stage(spans.join(named, KEY), "found")
    counted = base.select("alert_id", "description", *row_key("alert_id", "description"), word_count(text_of("description")).alias("n_words"))
    none = F.expr("array()").cast("array<struct<start:bigint,stop:bigint>>")
    return counted.join(found, KEY, "left").select(
        "alert_id", "description", "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("probe_ids", F.expr("array()").cast("array<string>")).alias("probe_ids"), F.coalesce("spans", none).alias("spans"))

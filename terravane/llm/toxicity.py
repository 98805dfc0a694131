"""Toxic alert texts: words are restored from a noisy channel, then scored by a trained model.

Channel: a letter may be written as a look-alike sign, be repeated, or be set apart from its neighbours, alone or with others.  The most
likely letters are found by Viterbi over the lattice of readings under a character 4-gram model of all texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from terravane.llm.texts import small_batches, text_of
from terravane.session import settle

ORDER = 4
LETTERS = 28  # 0: no letter, 1-26: a-z, 27: any other letter
TRAINING_ROWS = 20_000
FEATURES = 4_000
PREFIXES = range(3, 9)
KNOWN_TOKENS = 300_000
THRESHOLD = 0.3
# Signs that stand for letters.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
HIDDEN = "*#?"  # one unknown letter
MARKS = ".,;:!?\"'()[]{}<>|*#%&$€£§¡¿«»„“”…-_/\\~+="
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+*])(?:[ .\-_*/]{1,2}(?:[^\W_]|[@$!|+*])){2,}(?![^\W_])")
WORDS = re.compile(r"[^\W\d_]+")
DOUBLE = re.compile(r"(.)\1", re.S)
# Marks that stand for no letter; signs that do are judged where they stand, at the ends of a token too.
PLAIN_MARKS = "".join(c for c in MARKS if c not in LOOKALIKES and c not in HIDDEN)
SIGN = re.compile("[" + re.escape("".join(LOOKALIKES) + HIDDEN) + "]")
SHORTEST = 4  # shorter words are neither joined from pieces nor freed of plain doubles: too many clean texts hold them so


@lru_cache(maxsize=1)
def letter_codes():
    """Code of every character below U+0250, accents folded; letters beyond are 27."""
    import numpy as np

    codes = np.zeros(0x250, dtype=np.int32)
    for i in range(len(codes)):
        c = unicodedata.normalize("NFD", chr(i).lower())[0]
        codes[i] = ord(c) - 96 if "a" <= c <= "z" else 19 if c == "ß" else 27 if c.isalpha() else 0
    return codes


def char_grams(alerts: DataFrame, description: str = "description") -> DataFrame:
    """``gram, n``: counts of :data:`ORDER` consecutive letter codes over all descriptions, each with three blanks around it.

    Every task adds up its own texts, whichever texts share a batch; at most 28 to the power 4 different grams exist.
    """
    import pyarrow as pa

    small_batches(alerts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table, size, blanks = letter_codes(), LETTERS**ORDER, " " * (ORDER - 1)
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            text = blanks + blanks.join(batch.column(0).to_pylist()) + blanks
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            codes = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 27).astype(np.int32)
            if len(codes) < ORDER:
                continue
            gram = codes[: len(codes) - ORDER + 1].copy()
            for k in range(1, ORDER):
                gram *= LETTERS
                gram += codes[k : len(codes) - ORDER + 1 + k]
            total += np.bincount(gram, minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype("int32")), pa.array(total[found])], ["gram", "n"])

    partial = alerts.select(text_of(description).alias("description")).mapInArrow(count, "gram int, n long")
    return partial.groupBy("gram").agg(F.sum("n").alias("n"))


def char_model(grams: DataFrame):
    """log P(letter | three before) as a flat array, smoothed by the shorter contexts."""
    import numpy as np

    rows = grams.toPandas()  # bounded by the number of possible grams
    n4 = np.zeros(LETTERS**ORDER)
    n4[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    n4 = n4.reshape((LETTERS,) * ORDER)
    n3, n2 = n4.sum(0), n4.sum((0, 1))
    p1 = (n4.sum((0, 1, 2)) + 1) / (n4.sum() + LETTERS)
    p2 = (n2 + 2 * p1) / (n2.sum(1, keepdims=True) + 2)
    p3 = (n3 + 4 * p2) / (n3.sum(2, keepdims=True) + 4)
    p4 = (n4 + 8 * p3) / (n4.sum(3, keepdims=True) + 8)
    return np.log(p4).astype(np.float32).ravel()


class Channel:
    """Most likely letters behind a written token."""

    def __init__(self, model):
        self.model, self.codes = model.tolist(), letter_codes().tolist()

    def readings(self, sign: str, count: int) -> list[tuple[str, float]]:
        """Letters that ``count`` repeats of a sign may stand for, with the log cost of writing them so."""
        if sign in LOOKALIKES:
            # A repeated look-alike may stand for one letter or for as many.
            each = [(x, -1.5) for x in LOOKALIKES[sign]]
            out = each if count == 1 else [*each, *[(x * 2, c - 1.0) for x, c in each]]
            return [*out, ("", -7.0)]
        if sign in HIDDEN:
            return [*[(chr(97 + i), -4.5) for i in range(26)], ("", -4.0)]
        if sign.isalpha():
            if count == 1:
                return [(sign, 0.0)]
            if count == 2:
                return [(sign * 2, 0.0), (sign, -5.0)]
            return [(sign, -1.0), (sign * 2, -1.0)]
        return [("", -3.0)]

    def chance(self, letters: str) -> float:
        """Log-probability of letters and blanks, a blank around them."""
        x = y = z = 0
        total = 0.0
        for c in letters + " ":
            k = self.codes[ord(c)] if ord(c) < 0x250 else 27
            total += self.model[((x * LETTERS + y) * LETTERS + z) * LETTERS + k]
            x, y, z = y, z, k
        return total

    def read(self, token: str) -> str:
        if not DOUBLE.search(token) and not SIGN.search(token):
            return "".join(c for c in token if c.isalpha())
        code = lambda c: self.codes[ord(c)] if ord(c) < 0x250 else 27
        best: dict[tuple[int, int, int], tuple[float, str]] = {(0, 0, 0): (0.0, "")}
        i = 0
        while i < len(token):
            j = i
            while j < len(token) and token[j] == token[i]:
                j += 1
            following: dict[tuple[int, int, int], tuple[float, str]] = {}
            options = self.readings(token[i], j - i)
            if j == len(token) and token[i] in "!?":
                options = [*options[:-1], ("", -2.0)]  # often just the end of a sentence
            for (a, b, c), (score, text) in best.items():
                for letters, cost in options:
                    x, y, z, s = a, b, c, score + cost
                    for letter in letters:
                        k = code(letter)
                        s += self.model[((x * LETTERS + y) * LETTERS + z) * LETTERS + k]
                        x, y, z = y, z, k
                    old = following.get((x, y, z))
                    if old is None or s > old[0]:
                        following[(x, y, z)] = (s, text + letters)
            best, i = following, j
        close = lambda e: e[1][0] + self.model[((e[0][0] * LETTERS + e[0][1]) * LETTERS + e[0][2]) * LETTERS]
        return max(best.items(), key=close)[1][1]


def written_forms(token: str) -> tuple[list[str], list[str]]:
    """Plain words of a token in lower case, and the forms of it to restore: all but what has itself as its only reading."""
    if token.isalpha():
        return [token], [token] if DOUBLE.search(token) else []
    core = token.strip(MARKS)
    words = [core] if core.isalpha() else WORDS.findall(core)
    if not words:
        return [], []
    # With the signs at its ends, and without them.
    return words, [t for t in dict.fromkeys((token.strip(PLAIN_MARKS), core)) if not t.isalpha() or DOUBLE.search(t)]


def spelled(word: str) -> Iterator[str]:
    """Features of a restored word: the word and its beginnings."""
    yield word + "$"
    for n in PREFIXES:
        if len(word) < n:
            break
        yield word[:n]


def beginnings(words: Iterable[str]) -> frozenset[str]:
    """Every beginning of the words, the words themselves included."""
    return frozenset(w[:n] for w in words for n in range(1, len(w) + 1))


class Reader:
    """Features of texts; results of single tokens are remembered."""

    def __init__(self, model, chosen: dict[str, int] | None = None, known: int = KNOWN_TOKENS):
        self.channel, self.chosen, self.known = Channel(model), chosen, known
        self.seen: dict[str, tuple] = {}
        self.dull: set[str] = set()  # tokens without any chosen feature
        self.begun = beginnings(chosen or ())
        # Words that tell toxic texts; pieces of several letters are joined to these only.
        self.whole = frozenset(f[:-1] for f in chosen or () if f.endswith("$") and len(f) > SHORTEST)
        self.starts = beginnings(self.whole)

    def _pick(self, features: Iterable[str]) -> tuple:
        if self.chosen is None:
            return tuple(features)
        return tuple(i for i in (self.chosen.get(f) for f in features) if i is not None)

    def _token(self, token: str) -> tuple:
        words, disguised = written_forms(token)
        if self.chosen is None:
            features = {f for w in words for f in spelled(w)}
        else:
            # A word whose first letters begin no chosen feature has none.
            features = {f for w in words if (w + "$")[:3] in self.begun for f in spelled(w)}
        for t in disguised:
            if self._reachable(t):
                features |= set(spelled(self.channel.read(t)))
            for word in self._single(t):
                features |= set(spelled(word))
        return self._pick(features)

    def _reachable(self, form: str) -> bool:
        """Whether any reading of a form has a chosen feature; all readings walk along the beginnings of features at once.

        Where none has, the likeliest one has none, so decoding it could change nothing.
        """
        chosen, begun = self.chosen, self.begun
        if chosen is None:
            return True
        states = {""}
        for sign, run in groupby(form):
            following = set()
            for letters, _ in self.channel.readings(sign, len(list(run))):
                for word in states:
                    for letter in letters:
                        word += letter
                        if word in chosen:
                            return True
                        if word not in begun:
                            break
                    else:
                        following.add(word)
            if not following:
                return False
            states = following
        return any(word + "$" in chosen for word in states)

    def _single(self, form: str) -> Iterator[str]:
        """Known words that a form of letters is with runs of a letter written shorter, where the word is likelier than the form.

        What is known is the likelier beforehand: a shortened run costs as much as a sign between letters.  Any number of
        runs may be shortened: they are walked along the beginnings of known words.
        """
        if not self.whole or not form.isalpha():
            return
        states = {"": 0}
        for letter, run in groupby(form):
            n, following = len(list(run)), {}
            for word, short in states.items():
                for k in range(1, n + 1):
                    word += letter
                    if word not in self.starts:
                        break
                    following[word] = min(following.get(word, len(form)), short + (k < n))
            if not following:
                return
            states = following
        for word, short in states.items():
            if short and word in self.whole and self.channel.chance(word) - 3.0 * short > self.channel.chance(form):
                yield word

    def _joins(self, tokens: list[str]) -> Iterator[tuple[str, str]]:
        """Known words that are written as several neighbouring tokens, where the word is likelier than its pieces."""
        if not self.whole:
            return
        starts, whole = self.starts, self.whole
        pieces = [t.strip(MARKS) for t in tokens]
        for i in [i for i, p in enumerate(pieces) if p in starts]:
            run = pieces[i]
            for j in range(i + 1, len(pieces)):
                run += pieces[j]
                if not pieces[j] or run not in starts:
                    break
                if run in whole:
                    apart = " ".join(pieces[i : j + 1])
                    if self.channel.chance(run) - 3.0 * (j - i) > self.channel.chance(apart):
                        yield apart, run

    def _spaced(self, run: str) -> tuple:
        letters = self.channel.read(re.sub(r"[ .\-_*/]", "", run))
        # Several words may have been set apart letter by letter: each position may begin one.
        return self._pick({f for i in range(max(1, len(letters) - 2)) for f in spelled(letters[i:])})

    def __call__(self, text: str) -> set:
        text = text.lower()
        if len(self.seen) + len(self.dull) > self.known:
            self.seen.clear()
            self.dull.clear()
        seen, out = self.seen, set()
        tokens = text.split()
        for token in set(tokens) - self.dull:
            got = seen.get(token)
            if got is None:
                got = self._token(token)
                if got:
                    seen[token] = got
                else:
                    self.dull.add(token)
            out.update(got)
        for m in SPACED.finditer(text):
            out.update(self._spaced(m.group()))
        for _, word in self._joins(tokens):
            out.update(self._pick(spelled(word)))
        return out

    def restored(self, text: str) -> list[str]:
        """``written>read`` of everything disguised in a text, in order of the writing."""
        text, out = text.lower(), set()
        for token in set(text.split()):
            words, disguised = written_forms(token)
            out.update((token, r) for t in disguised for r in (self.channel.read(t), *self._single(t)) if r not in words)
        out.update(self._joins(text.split()))
        for m in SPACED.finditer(text):
            out.add((m.group(), self.channel.read(re.sub(r"[ .\-_*/]", "", m.group()))))
        return [f"{a}>{b}" for a, b in sorted(out) if a != b]


def _sample(labels: DataFrame, rows: int, alert_id: str, toxic: str) -> DataFrame:
    """At most ``rows`` labelled keys, chosen by a hash of the key; small enough to broadcast."""
    known = labels.filter(F.col(toxic).isNotNull() & F.col(alert_id).isNotNull())
    one = known.groupBy(F.col(alert_id).alias("alert_id")).agg(F.max(toxic).cast("int").alias("toxic"))
    return F.broadcast(one.orderBy(F.xxhash64("alert_id"), "alert_id").limit(rows))


def train(alerts: DataFrame, labels: DataFrame, model, rows: int = TRAINING_ROWS, features: int = FEATURES,
          alert_id: str = "alert_id", description: str = "description", toxic: str = "toxic") -> tuple[dict[str, int], object]:
    """Logistic regression over words and beginnings of words of restored texts.

    Learns from at most ``rows`` labelled alerts, of repeated ids from the smallest text, and keeps the ``features`` that
    best tell toxic ones apart.
    Returns the chosen features and their weights, the bias last.
    """
    import numpy as np
    import pandas as pd

    small_batches(alerts.sparkSession)
    # One text of each labelled id, so that ``rows`` bounds the texts too; they are read twice.
    chosen_rows = settle(alerts.select(F.col(alert_id).alias("alert_id"), text_of(description).alias("description")).join(
        _sample(labels, rows, alert_id, toxic), "alert_id").groupBy("alert_id", "toxic").agg(F.min("description").alias("description")))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        reader, counts = Reader(model, known=100_000), (Counter(), Counter())
        for frame in frames:
            for text, label in zip(frame["description"], frame["toxic"]):
                counts[label].update(reader(text))
        names = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"feature": names, "clean": [counts[0][f] for f in names], "bad": [counts[1][f] for f in names]})

    size = chosen_rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    n0, n1 = size["n"] - (size["bad"] or 0), size["bad"] or 0
    if not n0 or not n1:
        return {}, np.array([math.log((n1 + 0.5) / (n0 + 9.5))])
    seen = Observation()
    totals = chosen_rows.mapInPandas(counted, "feature string, clean long, bad long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).observe(seen, F.count("*").alias("n"))
    odds = F.log((F.col("bad") + 0.1) / (n1 + 1.0)) - F.log((F.col("clean") + 0.1) / (n0 + 1.0))
    # Log of how unlikely so many toxic ones among the texts of a feature are by chance.
    found, share = F.col("bad") + F.col("clean"), n1 / (n0 + n1)
    evidence = F.col("bad") * F.log(F.col("bad") / found / share) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / found / (1 - share))).otherwise(0.0)
    best = totals.filter("bad >= 2").withColumn("o", odds).filter("o > 2").withColumn("evidence", evidence).orderBy(
        F.col("evidence").desc(), "feature").limit(features).toPandas()
    # Among many rare features some fall together with the label by chance: each must be worth half the log of their number.
    best = best[best["evidence"] > 0.5 * math.log(seen.get["n"])]
    chosen = {f: i for i, f in enumerate(best["feature"])}

    def rowed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model, chosen, 100_000)
        for frame in frames:
            yield pd.DataFrame({"toxic": frame["toxic"], "ids": pd.Series([sorted(reader(t)) for t in frame["description"]], dtype=object)})

    data = chosen_rows.mapInPandas(rowed, "toxic int, ids array<int>").toPandas()  # at most ``rows`` short lists
    y = data["toxic"].to_numpy(float)
    lens = np.array([len(x) for x in data["ids"]])
    cols = np.concatenate([np.asarray(x, dtype=np.int64) for x in data["ids"]]) if lens.sum() else np.zeros(0, np.int64)
    at = np.repeat(np.arange(len(y)), lens)
    return chosen, _fit(at, cols, y, len(chosen))


def _fit(at, cols, y, width: int, ridge: float = 0.3, steps: int = 600):
    """Logistic regression with ridge by accelerated gradient steps; non-negative weights, bias last."""
    import numpy as np

    def scores(w):
        return w[-1] + np.bincount(at, weights=w[cols], minlength=len(y))

    def back(d):
        return np.append(np.bincount(cols, weights=d[at], minlength=width), d.sum())

    # The curvature is at most a quarter of the largest eigenvalue of the features' square, found by power iteration.
    v = np.ones(width + 1)
    for _ in range(30):
        v = back(scores(v))
        size = float(np.linalg.norm(v))
        v /= size
    rate = 1.0 / (0.25 * 1.05 * size + ridge)
    w = np.zeros(width + 1)
    w[-1] = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    look, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(scores(look), -30, 30)))
        g = back(p - y)
        g[:-1] += ridge * look[:-1]
        step = look - rate * g
        step[:-1] = np.maximum(step[:-1], 0.0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look = step + (t - 1) / t2 * (step - w)
        w, t = step, t2
    return w


def score_toxicity(
    alerts: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, features: int = FEATURES, threshold: float = THRESHOLD,
    alert_id: str = "alert_id", description: str = "description", toxic: str = "toxic", restored: bool = True,
) -> DataFrame:
    """Probability that a description is toxic, as ``labels(alert_id, toxic)`` mark it.

    Returns one row per row of ``alerts``: ``alert_id, description, score, predicted`` and, if asked for, ``restored``, an array of
    ``written>read`` for what was disguised.  The character model counts all descriptions; the classifier learns from at most
    ``rows`` of ``labels``.  A NULL or empty text has the score of a text without any known feature; without labels of
    both kinds all texts share one score; repeated rows get equal scores; other columns are ignored.
    """
    import pyarrow as pa

    model = char_model(char_grams(alerts, description))
    chosen, weights = train(alerts, labels, model, rows, features, alert_id, description, toxic)
    base = alerts.select(F.col(alert_id).alias("alert_id"), F.col(description).alias("description"))
    shared = alerts.sparkSession.sparkContext.broadcast((model, chosen, weights))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model, chosen, weights = shared.value
        reader = Reader(model, chosen)
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("description").to_pylist():
                ids = list(reader(text or ""))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(weights[-1] + weights[ids].sum()))))))
                if restored:
                    spans.append(reader.restored(text or ""))
            out = [*batch.columns, pa.array(scores, pa.float64()), pa.array(np.array(scores) >= threshold).cast(pa.int32())]
            names = [*batch.schema.names, "score", "predicted"]
            if restored:
                out, names = [*out, pa.array(spans, pa.list_(pa.string()))], [*names, "restored"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", score double, predicted int"
    return base.mapInArrow(scored, schema + (", restored array<string>" if restored else ""))


def keep_clean(alerts: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, alert_id: str = "alert_id", description: str = "description") -> DataFrame:
    """The alerts whose score stays below ``threshold``, all columns as they are."""
    import pyarrow as pa

    model = char_model(char_grams(alerts, description))
    chosen, weights = train(alerts, labels, model, alert_id=alert_id, description=description)
    shared = alerts.sparkSession.sparkContext.broadcast((model, chosen, weights))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, chosen, weights = shared.value
        reader = Reader(model, chosen)
        limit = math.log(threshold / (1 - threshold))
        for batch in batches:
            texts = batch.column(description).to_pylist()
            yield batch.filter(pa.array([float(weights[-1] + weights[list(reader(t or ""))].sum()) < limit for t in texts], pa.bool_()))

    return alerts.mapInArrow(kept, alerts.schema)

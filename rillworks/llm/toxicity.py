"""Toxicity: a learnt lexicon as a trie, met by Levenshtein automata so that misspelt terms count, and scores of each hit's context.

The trie's Levenshtein automaton is made deterministic as it is used: a state is the set of (trie node, edits) that the letters so far can be at,
and each (state, letter) is worked out once. Most words leave it after a few letters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, crc_mod, map_arrow, mix, stored, table

#: Labelled rows that the lexicon and the weights are learnt from, at most (those with the smallest hash of their id, then of their text).
SAMPLE = 20_000
#: A term has this many independent uses at least in toxic texts (copies of a passage are one use); this share of its independent uses is there, and
#: a lower one in each half of the texts, so that it is borne out by texts that did not suggest it.
MIN_CONTEXTS, MIN_SHARE, HALF_SHARE = 5, 0.8, 0.6
#: Words that would become terms by chance alone, over the whole lexicon.
BY_CHANCE = 0.05
#: Misspellings count for terms of so many independent uses, unless less than this share of the uses of words an edit or two away, which are no terms,
#: is in toxic texts; and the uses in favour that stand in for evidence.
EDIT_CONTEXTS, EDIT_SHARE, EDIT_PRIOR = 20, 0.5, 2.0
#: Words to either side of a hit that tell what it is used for.
WINDOW = 6
#: Uses that are counted at once, at least.
COUNTED_AT_ONCE = 50_000
#: Columns of the hashes by which uses of a word are told apart, and what the words around it are multiplied by.
KEYS = ["near", "far0", "far1", "far2", "far3"]
POWERS = mix(np.arange(2_000, 2_000 + 2 * WINDOW, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: What hits are expected to count that are quoted, reported, addressed to someone (besides), one edit and two edits off, in plain hits; how strongly what is
#: learnt is drawn to that; and the values that are tried.
PRIOR, PULL, TRIED = (0.35, 0.5, 0.25, 0.7, 0.5), 2.0, (0.0, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 1.0, 1.25)
OPEN, CLOSE = "\"“„«‘", "\"”“»’"
#: Fixed words that report what others say, and that address someone.
REPORTING = frozenset("said says called wrote quoted quote term word slur phrase title titled sagte schrieb zitat wort begriff dit écrit cité mot terme dijo escribió cita palabra término".split())
ADDRESS = frozenset("you your you're youre u ur du dich dein deine ihr euch tu toi ton ta vous votre tú tu usted eres".split())
EDGE = ".,;:!?()[]{}\"'“”„«»‘’*_-–—…|#%&$"


def edits_for(n: int) -> int:
    return 0 if n < 5 else 1 if n < 9 else 2


class Lexicon:
    """Terms, with the edits that each allows. ``look(word)``: None, or (edits, weight, the term's number in order)."""

    def __init__(self, terms: list[tuple[str, int, float]], clean: frozenset[str] = frozenset()):
        self.clean = clean
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[int, float, int]] = {}
        self.reach = [0]
        for number, (term, allowed, weight) in enumerate(sorted(terms)):
            node = 0
            self.reach[0] = max(self.reach[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], allowed)
            self.ends[node] = (allowed, weight, number)
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.hit: list[tuple[int, float, int] | None] = []
        self.begin = self._state({(0, 0, "")})
        self.seen: dict[str, tuple[int, float, int] | None] = {}

    def _state(self, found: set) -> int:
        todo = list(found)
        while todo:  # letters of a term that the word leaves out
            node, e, due = todo.pop()
            if not due:
                for child in self.children[node].values():
                    if e < self.reach[child] and (child, e + 1, "") not in found:
                        found.add((child, e + 1, ""))
                        todo.append((child, e + 1, ""))
        state = frozenset(found)
        if state not in self.states:
            self.states[state] = len(self.sets)
            self.sets.append(state)
            self.moves.append({})
            ends = [(e, *self.ends[n][1:]) for n, e, due in state if n in self.ends and not due and e <= self.ends[n][0]]
            self.hit.append(min(ends, key=lambda x: (x[0], -x[1], x[2]), default=None))
        return self.states[state]

    def _move(self, at: int, c: str) -> int:
        found = set()
        for node, e, due in self.sets[at]:
            if due:
                if due == c:
                    found.add((node, e, ""))
                continue
            if c in self.children[node]:
                found.add((self.children[node][c], e, ""))
            if e < self.reach[node]:
                found.add((node, e + 1, ""))  # a letter too many
                for x, child in self.children[node].items():
                    if x != c:
                        if e < self.reach[child]:
                            found.add((child, e + 1, ""))  # another letter
                        if c in self.children[child]:
                            found.add((self.children[child][c], e + 1, x))  # two letters swapped
        self.moves[at][c] = to = self._state(found) if found else -1
        return to

    def look(self, word: str) -> tuple[int, float, int] | None:
        at = self.begin
        for c in word:
            to = self.moves[at].get(c)
            at = self._move(at, c) if to is None else to
            if at < 0:
                return None
        return self.hit[at]

    def judged(self, token: str) -> tuple[int, float, int] | None:
        """Of a token as it stands between white space; kept, as most tokens come again and again."""
        found = self.seen.get(token, 0)
        if found == 0:
            if len(self.seen) > 100_000:
                self.seen.clear()
            word = token.strip(EDGE)
            found = self.seen[token] = None if word in self.clean else self.look(word)
        return found


def evidence(text: str | None, lexicon: Lexicon) -> tuple[float, ...]:
    """The weights of a text's hits by kind (plain, quoted, reported, addressed besides, one edit off, two), and the number of words."""
    words = (text or "").lower().split()
    seen, sums = lexicon.seen, [0.0] * 6
    hits = [i for i, w in enumerate(words) if (seen[w] if w in seen else lexicon.judged(w)) is not None]
    for i in hits:
        edits, weight, _ = lexicon.judged(words[i])
        before, after = words[max(0, i - WINDOW) : i + 1], words[i : i + WINDOW + 1]
        near = {w.strip(EDGE) for w in (*before, *after)}
        if any(w[0] in OPEN for w in before) and any(w.rstrip(".,;:!?")[-1:] in CLOSE and w.rstrip(".,;:!?") for w in after):
            sums[1] += weight
        elif near & REPORTING:
            sums[2] += weight
        else:
            sums[3 + edits if edits else 0] += weight
        if near & ADDRESS:
            sums[3] += weight
    return *sums, len(words)


def features(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A constant, and of what all hits count together: the logarithm, how far it is a whole hit, and how much it is by words."""
    total = found[:, :6] @ np.r_[1.0, counts]
    return np.stack([np.ones(len(found)), np.log1p(total), np.minimum(total, 1.0), np.minimum(total / np.maximum(found[:, 6], 1) * 50, 2.0)], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Newton's steps for a ridge logistic regression whose first weight (the constant) is free; and its penalised likelihood."""
    w, penalty = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    z = np.clip(x @ w, -30, 30)
    return w, float((y * z - np.log1p(np.exp(z))).sum() - (penalty * w * w).sum() / 2)


def fit(found: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what each kind of hit counts, the regression's weights). Kinds are learnt in turn; one that the texts say nothing of stays as expected."""
    prior = np.array(PRIOR)
    counts = prior.copy()
    value = lambda c: logistic(features(found, c), y)[1] - PULL * ((c - prior) ** 2).sum()
    for _ in range(2):
        for kind in range(len(prior)):
            if found[:, 1 + kind].any():
                tried = [np.r_[counts[:kind], c, counts[kind + 1 :]] for c in {*TRIED, prior[kind]}]
                counts = max(tried, key=value)
    return counts, logistic(features(found, counts), y)[0]


def uses(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of rows (text, y) each word w of three letters or more, y (any number), and five hashes of where it stands: its two neighbours, and of the 12 nearest words
    four groups of three, two to a side. Near copies of a passage agree in one of them; texts of less than 13 words have their neighbours alone."""
    words, span = Words(batch.column(0)), 2 * WINDOW + 1
    h, counts = words.hashes(), np.diff(words.first)
    i, lo, hi = np.arange(len(h)), np.repeat(words.first[:-1], counts), np.repeat(words.first[1:], counts)
    padded = np.r_[np.uint64(0), h, np.uint64(0)]
    near = mix(np.where(i > lo, padded[:-2], np.uint64(0)) * POWERS[0] + np.where(i + 1 < hi, padded[2:], np.uint64(0)) * POWERS[1])
    begin, keys = np.maximum(np.minimum(i - WINDOW, hi - span), lo), [near]
    for g in range(4):
        total = np.full(len(h), g, np.uint64)
        for j in range(WINDOW * (g // 2) + g % 2, WINDOW * (g // 2 + 1), 2):
            at = begin + j
            total += h[np.minimum(at + (at >= i), len(h) - 1)] * POWERS[j]
        keys.append(np.where(hi - lo >= span, mix(total), near))
    sizes = words.end - words.start
    ends = np.concatenate(([0], np.cumsum(sizes)))
    letters = words.text[np.arange(ends[-1]) + np.repeat(words.start - ends[:-1], sizes)]
    w = pa.StringArray.from_buffers(len(h), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters.tobytes()))
    y = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32), counts)
    out = pa.RecordBatch.from_arrays([w, pa.array(y), *[pa.array(k.view(np.int64)) for k in keys]], names=["w", "y", *KEYS])
    return out.filter(pc.greater_equal(pc.utf8_length(w), 3))


def independent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of uses (w, y + 2 * half, five hashes) sorted by word: for each word its independent uses by y and half. A use counts by one over the number of
    uses of its word, in texts of the same y, that share the hash most of them share."""
    names = ["w", "bad0", "bad1", "good0", "good1"]

    def counted(rows: pa.Table) -> pa.RecordBatch:
        code = rows.column(0).combine_chunks().dictionary_encode()
        word, y = code.indices.to_numpy().astype(np.uint64), rows.column(1).to_numpy().astype(np.uint64)
        alike = np.ones(len(word), np.int64)
        for i in range(2, 2 + len(KEYS)):
            whole = mix(mix(word * np.uint64(2) + y % np.uint64(2) + np.uint64(1)) + rows.column(i).to_numpy().view(np.uint64))
            _, place, count = np.unique(whole, return_inverse=True, return_counts=True)
            alike = np.maximum(alike, count[place])
        total = np.bincount((word * np.uint64(4) + y).astype(np.int64), 1 / alike, 4 * len(code.dictionary)).reshape(-1, 4).round(6)
        return pa.RecordBatch.from_arrays([code.dictionary, *[pa.array(total[:, c]) for c in (1, 3, 0, 2)]], names=names)

    held: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch.column(0)[len(batch) - 1]
        at = pc.index(batch.column(0), last).as_py()
        if at:
            held.append(pa.Table.from_batches([batch.slice(0, at)]))
        # All words before the last one are whole; some of them are counted at once.
        if held and sum(h.num_rows for h in held) >= COUNTED_AT_ONCE and held[-1].column(0)[-1] != last:
            yield counted(pa.concat_tables(held))
            held = []
        held.append(pa.Table.from_batches([batch.slice(at)]))
    if held:
        yield counted(pa.concat_tables(held))


def learn_lexicon(sample: DataFrame) -> tuple[list[tuple[str, int, float]], frozenset[str]]:
    """Terms (term, edits it allows, weight) from rows (text, y); and words of the sample's clean texts that are no misspelling though they are as
    close to a term as one. Both grow with the sample, which is bounded; nothing else bounds them.

    A use counts by one over the number of uses of its word, in texts of the same label, that share the hash most of them share: copies, near copies and
    repetitions of a passage come to about one use, and other uses of the word count beside them. A term stands out in toxic texts by more than chance
    gives the words that were looked at, and does so in both halves of the texts. Misspellings are believed of a term that is not rare, as far as the words near it that
    are no terms are in toxic texts.
    """
    plain = F.array_join(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), " ")
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    texts = sample.select("text", "y").distinct().select(plain.alias("text"), (F.col("y") + 2 * half).alias("y"))
    found = map_arrow(texts, uses, f"w string, y int, {', '.join(f'{k} long' for k in KEYS)}")
    # A word's uses follow each other in a sorted stream; they are as many as the sample has, at most.
    words = stored(found.repartition("w").sortWithinPartitions("w").mapInArrow(independent, "w string, bad0 double, bad1 double, good0 double, good1 double"), "words")
    words = words.withColumns({"bad": F.col("bad0") + F.col("bad1"), "good": F.col("good0") + F.col("good1")})
    looked = words.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count_if(F.col("bad") + F.col("good") >= MIN_CONTEXTS).alias("n")).first()
    if not looked["n"] or not looked["bad"]:
        return [], frozenset()
    base = min(looked["bad"] / (looked["bad"] + looked["good"]), MIN_SHARE)
    share = F.col("bad") / (F.col("bad") + F.col("good"))
    # Chernoff's bound on the chance of such a share.
    gain = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    sure = (F.col("bad") + F.col("good")) * gain >= math.log(max(1.0, looked["n"] / BY_CHANCE))
    both = [(F.col(f"bad{h}") > 0) & (F.col(f"bad{h}") >= HALF_SHARE * (F.col(f"bad{h}") + F.col(f"good{h}"))) for h in (0, 1)]
    terms = words.where((F.col("bad") >= MIN_CONTEXTS) & (share >= MIN_SHARE) & sure & both[0] & both[1])
    chosen = sorted((r["w"], edits_for(len(r["w"])) if r["bad"] >= EDIT_CONTEXTS else 0, min(1.0, math.log((r["bad"] + 0.5) / (r["good"] + 0.5)) / 4)) for r in terms.select("w", "bad", "good").collect())
    alike = Lexicon(chosen)

    def close(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits = [alike.look(w) for w in batch.column(0).to_pylist()]
        some = [i for i, hit in enumerate(hits) if hit and hit[0]]
        near = batch.take(pa.array(some, pa.int64()))
        return pa.RecordBatch.from_arrays([*near.columns, pa.array([hits[i][0] for i in some], pa.int32()), pa.array([hits[i][2] for i in some], pa.int32())], names=["w", "bad", "good", "edits", "term"])

    near = stored(map_arrow(words.select("w", "bad", "good"), close, "w string, bad double, good double, edits int, term int"), "near")
    against = {(r["term"], r["edits"]): (r["bad"] + EDIT_PRIOR) / (r["bad"] + r["good"] + EDIT_PRIOR) for r in near.groupBy("term", "edits").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()}
    believed = lambda i, e: all(against.get((i, k), 1.0) >= EDIT_SHARE for k in range(1, e + 1))
    chosen = [(w, max(e for e in range(allowed + 1) if believed(i, e)), weight) for i, (w, allowed, weight) in enumerate(chosen)]
    allows = {i: e for i, (_, e, _) in enumerate(chosen)}
    clean = near.where((F.col("good") > 0) & (F.col("bad") < MIN_SHARE * (F.col("bad") + F.col("good")))).select("w", "edits", "term").collect()
    return chosen, frozenset(r["w"] for r in clean if r["edits"] <= max(allows.values()))


def judge(df: DataFrame, labels: DataFrame, learn_from, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, corpus: DataFrame | None = None) -> DataFrame:
    """df with ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (score >= 0.5); columns of these names are replaced.

    Learns from rows of corpus (df, if not given) whose id has a 0/1 label in ``labels`` (1, if it has both) and for which the column learn_from(id)
    holds: up to ``sample`` different texts, repeated rows counting once. What hits in quotation, in reports, addressed to someone and off by edits count is learnt
    beside what plain hits do. Null and empty texts hold no term and get the score of such texts; a score of just 0.5 is predicted toxic; texts of any length are read whole.
    Without labels of both kinds every score is 0. Rows and other columns stay as they are.
    """
    spark = df.sparkSession
    ids = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & learn_from).groupBy(F.col(id_col).alias("_k")).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("_k"), "_k").limit(sample)
    rows = (corpus or df).select(F.col(id_col).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), "_k").distinct()
    if not rows.groupBy("_k").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # an id with several texts: rows are bounded, not ids
        rows = rows.orderBy(F.xxhash64("_k"), "_k", F.xxhash64("text"), "text").limit(sample)
    texts = stored(rows.select("text", "y"), "labelled")
    sent = spark.sparkContext.broadcast(learn_lexicon(texts))
    cache: list[Lexicon] = []

    def measured(column: pa.Array) -> np.ndarray:
        if not cache:
            cache.append(Lexicon(*sent.value))
        return np.array([evidence(t, cache[0]) for t in column.to_pylist()], float).reshape(-1, 7)

    kinds_of = [f"f{i}" for i in range(7)]

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(x) for x in measured(batch.column(0)).T]], names=["y", *kinds_of])

    seen = map_arrow(texts, look, f"y int, {', '.join(f'{n} double' for n in kinds_of)}").toPandas()
    y = seen["y"].to_numpy(float)
    counts, weights = fit(seen[kinds_of].to_numpy(), y) if 0 < y.sum() < len(y) else (np.array(PRIOR), np.r_[-40.0, np.zeros(3)])

    at = df.columns.index(text)
    names = [f"c{i}" for i in range(len(df.columns))]

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = measured(batch.column(0))
        p = 1 / (1 + np.exp(-np.clip(features(found, counts) @ weights, -30, 30)))
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names[1:], "score", "predicted"])

    plain = df.toDF(*names)
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema, strict=True))
    out = map_arrow(plain.select(F.col(names[at]).alias("t"), *names), score, f"{kinds}, score double, predicted int")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True) if c not in ("score", "predicted")], "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    slim = judge_slim(docs, table(spark, sf_dir, "labels"))
    return slim.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def judge_slim(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels, crc_mod("doc_id", 5) != 0)


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE: dict[str, str] = {}

"""Toxicity by weak supervision.

Many voters - words, word starts and patterns - fire or don't on each whole text. A generative model of two classes,
fitted by expectation maximisation to how often each combination of votes occurs in all documents, estimates how
each voter fires in either class and how the voters of a class go together; both are estimated anew in every round,
and voters that go together share their weight in the next one, so that voters that say the same thing don't count
twice. The model's posterior labels train a linear classifier over the votes and the shares of words and word starts
in the text, which scores every text.

Voters are mined from labelled rows: a word, or the first 4 to 8 bytes of words, votes if it occurs at all, or if it
makes up one in 200 or one in 100 words, whichever tells the classes apart best. Every candidate that does so beyond
what chance gives among so many candidates votes, without a limit on their number; of nested ones (a word, its
starts) those that tell best. A start is a character n-gram that compounds of one stem share.

Labels are used to mine voters, to start the generative model and as one more vote of a known accuracy on the
training rows. They come from the given rows only; the caller leaves held-out rows away.

Bounded: at most `sample` labelled rows, chosen by a hash of their ids, mine voters and train the classifier (a
documented parameter; of texts that share their least shingle hash, as copies and most near copies do, one counts, or
the words of a text that was copied a thousand times would all look like insults). Vote combinations are counted over all documents, on the
executors; what reaches the driver is bounded by the sample and by a few sums for each pair of voters.

Defined results: null and empty texts have no votes and get the classifier's base score; bytes that aren't UTF-8 are
replaced; labels of one id that disagree count as toxic; null ids have no label; repeated rows are each scored;
without labels of both classes the model starts from the fixed lexicon and is itself the classifier; the empty table
gives the empty table; other columns are ignored, or kept by keep_mild.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest

from .common import Workspace, annotate, arrow_rows, as_bytes, fresh, small_slices, text_of
from .ngrams import WordHashes, ascii_words, ngram_hashes

# Insults that vote before any label is seen.
INSULTS = tuple("bastard bitch clown crap cretin damn disgusting dumb dumbass filth fool freak garbage hate idiot imbecile jerk loser moron pathetic pig retard scum shit shut stupid sucks trash ugly vermin worthless".split())
# Patterns that vote, with literals of which a text must hold one, both on texts with letters lowered unless a literal is None.
PATTERNS = (
    ((b"you",), rb"you(?<=\byou)(?:'re| are)? (?:all )?(?:such )?an? "), ((b"shut up",), rb"\bshut up\b"), ((b"go to hell",), rb"\bgo to hell\b"), ((b"!!!",), rb"!{3}"),
    (None, rb"[A-Z]{4}(?<![A-Za-z0-9_][A-Z]{4})[A-Z]*\b[^a-z]{1,3}\b[A-Z]{4,}\b"), ((b"kill ", b"hurt "), rb"\b(?:kill|hurt) (?:you|them|him|her)\b"),
    ((b"*", b"#", b"@", b"$", b"%"), rb"[*#@$%]{3}"), ((b"*",), rb"\b[a-z]+\*+[a-z]*\b"),
)
#: A gram votes from one of these shares of a text's words on (zero: if it occurs), with so many words added to each text.
LEVELS, EXTRA = (0.0, 0.005, 0.01), 20
#: How many first bytes of a word are its starts, and from how many bytes on a digest stands for a whole word.
STARTS, LONGEST = (4, 5, 6, 7, 8), 64
#: What a share counts for in the classifier: one word in fifty is worth 1.
WORTH = 50.0
#: A voter that doesn't fire counts half: silence of many voters is one event, as a toxic text holds a few insults of many.
SILENCE = 0.5
#: The accuracy of a given label, as a vote on its own row.
LABEL_ACCURACY = 0.95


def words_in(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters with all letters lowered."""
    return ascii_words(text.decode(errors="replace").lower().encode())


def grams_of(word: bytes) -> list[bytes]:
    """The whole word, marked by a blank, and its starts."""
    whole = word if len(word) <= LONGEST else xxh3_128_hexdigest(word).encode()
    return [whole + b" ", *(word[:k] for k in STARTS if k < len(word))]


def likeness(text: bytes) -> int:
    """The least hash of a text's three-word shingles, which most of its near copies share."""
    words = words_in(text)
    return int(ngram_hashes(WordHashes().of(words), min(3, len(words))).min() >> np.uint64(1)) if words else 0


class Known(dict):
    """Of each word met so far the numbers of its grams that matter; forgets all when full, so memory stays bounded."""

    def __init__(self, numbers: dict[bytes, int], most: int = 1 << 17):
        super().__init__()
        self.numbers, self.most = numbers, most

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = tuple(self.numbers[g] for g in grams_of(word) if g in self.numbers)
        return out


@dataclass(frozen=True)
class Voters:
    """grams: the words and starts that are features; chosen: (gram's number, level) of those that vote, before the patterns."""

    grams: tuple[bytes, ...]
    chosen: tuple[tuple[int, int], ...]
    patterns: tuple[tuple[tuple[bytes, ...] | None, bytes], ...] = PATTERNS

    def __len__(self) -> int:
        return len(self.chosen) + len(self.patterns)

    @cached_property
    def known(self) -> Known:
        return Known({g: k for k, g in enumerate(self.grams)})

    @cached_property
    def levels(self) -> dict[int, tuple[int, float]]:
        """Voter and least share by gram."""
        return {g: (k, LEVELS[level]) for k, (g, level) in enumerate(self.chosen)}

    def __getstate__(self) -> dict:  # what is remembered of words stays behind
        return {"grams": self.grams, "chosen": self.chosen, "patterns": self.patterns}

    def read(self, text: bytes) -> tuple[list[int], dict[int, float]]:
        """The voters that fire, ascending, and the share of each gram that occurs."""
        words, found, known = words_in(text), Counter(), self.known
        for w, n in Counter(words).items():
            for g in known[w]:
                found[g] += n
        shares = {g: n / (len(words) + EXTRA) for g, n in found.items()}
        fired = [at[0] for g, share in shares.items() if (at := self.levels.get(g)) and share >= at[1]]
        low = text.lower()
        for k, (literals, p) in enumerate(self.patterns, len(self.chosen)):
            # most texts lack the literals, which are found much faster than patterns
            if re.search(p, text) if literals is None else any(x in low for x in literals) and re.search(p, low):
                fired.append(k)
        return sorted(fired), shares


def dense(lists: pa.ListArray, k: int) -> np.ndarray:
    """Votes given as lists of voters, as a matrix."""
    out = np.zeros((len(lists), k))
    sizes = np.diff(np.asarray(lists.offsets))
    out[np.repeat(np.arange(len(lists)), sizes), np.asarray(lists.flatten())] = 1
    return out


def tallied(rows: DataFrame) -> DataFrame:
    """rows: text, toxic -> gram and, for each level, n (rows where it reaches the level) and t (toxic ones)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        counts = {(level, y): Counter() for level in range(len(LEVELS)) for y in (0, 1)}
        for batch in small_slices(batches, "text"):
            for text, y in zip(as_bytes(batch, "text"), batch.column(1).to_pylist()):
                words, found = words_in(text), Counter()
                for w, n in Counter(words).items():
                    for g in grams_of(w):
                        found[g] += n
                reached: dict[int, list[bytes]] = {level: [] for level in range(len(LEVELS))}
                for g, n in found.items():
                    reached[sum(n / (len(words) + EXTRA) >= x for x in LEVELS[1:])].append(g)
                for level, grams in reached.items():
                    counts[level, y].update(grams)
            if sum(map(len, counts.values())) > 1 << 18:
                yield listed(counts)
        yield listed(counts)

    def listed(counts: dict[tuple[int, int], Counter]) -> dict[str, list]:
        out: dict[str, list] = {"gram": [], "level": [], "toxic": [], "n": []}
        for (level, y), each in counts.items():
            out["gram"] += each.keys()
            out["n"] += each.values()
            out["level"] += [level] * len(each)
            out["toxic"] += [y] * len(each)
            each.clear()
        return out

    schema = "gram binary, level int, toxic int, n long"
    sums = [F.sum(F.when((F.col("level") >= k) & (F.col("toxic") >= y), F.col("n")).otherwise(0)).alias(f"{'nt'[y]}{k}") for k in range(len(LEVELS)) for y in (0, 1)]
    return rows.mapInArrow(arrow_rows(schema, make), schema).groupBy("gram").agg(*sums)


def excess(n: np.ndarray, t: np.ndarray, base: float) -> np.ndarray:
    """By how many standard deviations t of n exceeds chance."""
    return (t - base * n) / np.sqrt(np.maximum(1e-12, base * (1 - base) * n))


def mine(tally: DataFrame, base: float, least: int = 5) -> Voters:
    """The grams in `least` rows or more that differ between classes by two deviations, and of these the voters.

    A voter exceeds chance by more than the largest of so many candidates would, and half of its rows are toxic at least.
    """
    fixed = [w.encode() + b" " for w in INSULTS]
    if not 0 < base < 1:
        return Voters(tuple(fixed), tuple((k, 0) for k in range(len(fixed))))
    often = tally.where(F.col("n0") >= least)
    z = [(F.col(f"t{k}") - base * F.col(f"n{k}")) / F.sqrt(base * (1 - base) * F.greatest(F.lit(1), F.col(f"n{k}"))) for k in range(len(LEVELS))]
    told = often.where((F.abs(z[0]) >= 2) | (F.greatest(*z) >= 3)).toArrow()  # bounded by the sample
    limit = max(3.0, (2 * np.log(max(2, often.count()))) ** 0.5)
    n, t = (np.array([told[f"{c}{k}"].to_numpy() for k in range(len(LEVELS))], float) for c in "nt")
    scores = np.where((t >= least) & (t >= 0.5 * n), excess(np.maximum(n, 1), t, base), -np.inf)
    names = told["gram"].to_pylist()
    best = {g: (float(scores[level, k]), int(level)) for k, (g, level) in enumerate(zip(names, scores.argmax(0))) if scores[level, k] >= limit}
    worse = set()
    for g, (score, _) in best.items():
        for a in (g[:k] for k in STARTS if k < len(g.rstrip(b" "))):
            if a in best:
                worse.add(a if score >= best[a][0] else g)
    chosen = {g: level for g, (_, level) in sorted(best.items()) if g not in worse}
    chosen |= {g: 0 for g in fixed if g not in chosen}
    grams = tuple(sorted({*names, *chosen}))
    number = {g: k for k, g in enumerate(grams)}
    return Voters(grams, tuple((number[g], level) for g, level in chosen.items()))


@dataclass(frozen=True)
class LabelModel:
    """P(voter fires | class), the prior of class 1, and each voter's weight: its share of what the voters it goes with say."""

    fires: np.ndarray  # [class, voter]
    prior: float
    weight: np.ndarray

    def logits(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.fires[1] / self.fires[0])
        off = np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        return np.log(self.prior / (1 - self.prior)) + votes @ (self.weight * on) + SILENCE * ((1 - votes) @ (self.weight * off))

    def posterior(self, votes: np.ndarray, said: np.ndarray | float = 0.0) -> np.ndarray:
        """P(class 1); said: what else speaks for it, as a logit."""
        return 1 / (1 + np.exp(-np.clip(self.logits(votes) + said, -40, 40)))


def expected(votes: np.ndarray, n: np.ndarray, model: LabelModel) -> np.ndarray:
    """The E-step's sums over vote combinations: class sizes, fires [class, voter] and joint fires [class, voter, voter], flat."""
    q = model.posterior(votes)
    by_class = [w[:, None] * votes for w in (n * (1 - q), n * q)]
    return np.concatenate([[(n * (1 - q)).sum(), (n * q).sum()], *[x.sum(0) for x in by_class], *[(x.T @ votes).reshape(-1) for x in by_class]])


def maximised(sums: np.ndarray, start: LabelModel, labelled: bool) -> LabelModel:
    """The M-step: rates, prior, and weights from the correlations of voters within the classes.

    A start from labels counts like all documents again, classes as in the labels, so that the classes keep their
    meaning: a toxic class of several languages would shrink to the largest otherwise. Any other start counts like 50
    documents of each class.
    """
    k = len(start.weight)
    sizes, fired, joint = sums[:2], sums[2 : 2 + 2 * k].reshape(2, k), sums[2 + 2 * k :].reshape(2, k, k)
    held = sizes.sum() * np.array([1 - start.prior, start.prior]) if labelled else np.full(2, 50.0)
    fires = np.clip((fired + held[:, None] * start.fires) / (sizes + held)[:, None], 1e-5, 1 - 1e-5)
    fires[1] = np.maximum(fires[1], fires[0])  # a vote never speaks against toxicity
    rate = fired / np.maximum(sizes[:, None], 1e-9)
    spread = np.sqrt(np.clip(rate * (1 - rate), 1e-12, None))
    shared = (joint / np.maximum(sizes[:, None, None], 1e-9) - rate[:, :, None] * rate[:, None, :]) / (spread[:, :, None] * spread[:, None, :])
    together = np.clip((shared * (sizes / max(1.0, sizes.sum()))[:, None, None]).sum(0), 0, 1)
    together[together < 0.1] = 0
    np.fill_diagonal(together, 0)
    prior = (sizes[1] + held[1] * labelled) / max(1e-9, (sizes + held * labelled).sum())
    return LabelModel(fires, float(np.clip(prior, 0.005, 0.5)), 1 / (1 + together.sum(1)))


def fit_label_model(patterns: DataFrame, start: LabelModel, labelled: bool, rounds: int = 20) -> LabelModel:
    """patterns: votes (ascending numbers of voters), n (documents); labelled: whether the start comes from labels."""
    model, k = start, len(start.weight)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        total = np.zeros(2 + 2 * k + 2 * k * k)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                total += expected(dense(part.column(0), k), np.asarray(part.column(1)).astype(float), model)
        yield {"sums": [total.tolist()]}

    schema = "sums array<double>"
    for _ in range(rounds):
        total = np.zeros(2 + 2 * k + 2 * k * k)
        for r in patterns.mapInArrow(arrow_rows(schema, make), schema).toLocalIterator():  # a row for each task, one at a time
            total += np.array(r["sums"])
        if total[:2].sum() == 0:
            return start
        following = maximised(total, start, labelled)
        moved = max(abs(following.prior - model.prior), np.abs(following.fires - model.fires).max())
        model = following
        if moved < 1e-3:
            break
    return model


@dataclass(frozen=True)
class Toxicity:
    """The trained scorer."""

    voters: Voters
    votes: np.ndarray
    shares: np.ndarray
    base: float

    def score(self, text: bytes) -> float:
        fired, shares = self.voters.read(text)
        x = self.base + sum(self.votes[k] for k in fired) + WORTH * sum(self.shares[g] * share for g, share in shares.items())
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def train_linear(votes: np.ndarray, sizes: np.ndarray, grams: np.ndarray, shares: np.ndarray, n_grams: int, target: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft labels, by full-batch Adam with a little shrinkage; row i has the next sizes[i] grams.

    Both classes weigh the same in all, so that a score of one half is as far from either.
    """
    k, n = votes.shape[1], len(target)
    rows, worth = np.repeat(np.arange(n), sizes), WORTH * shares
    mean = float(np.clip(target.mean(), 1e-3, 0.999))
    balance = target * (0.5 / mean) + (1 - target) * (0.5 / (1 - mean))
    w, m, v = np.zeros(k + n_grams + 1), np.zeros(k + n_grams + 1), np.zeros(k + n_grams + 1)
    for t in range(1, steps + 1):
        x = w[-1] + votes @ w[:k] + np.bincount(rows, worth * w[k:-1][grams], n)
        error = balance * (1 / (1 + np.exp(-np.clip(x, -40, 40))) - target) / n
        g = np.concatenate([error @ votes, np.bincount(grams, worth * error[rows], n_grams), [error.sum()]])
        g[:-1] += 1e-5 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:k], w[k:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample: int = 20_000) -> Toxicity:
    """docs: all documents; labels: id and label of the rows to learn from."""
    work = Workspace(docs.sparkSession, "toxicity")
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("id").agg(F.least(F.lit(1), F.max("toxic")).alias("toxic"))
    chosen = work.write(known.orderBy(F.xxhash64("id"), "id").limit(sample), "labels")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    rows = texts.join(chosen, "id").groupBy(F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = annotate(rows, "text", "likeness long", lambda values: {"likeness": [likeness(t) for t in values]})
    rows = work.write(rows.groupBy("likeness").agg(F.min_by("text", "sha").alias("text"), F.min_by("toxic", "sha").alias("toxic")).select("text", "toxic"), "labelled")
    n, toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
    voters = mine(work.write(tallied(rows), "tally"), (toxic or 0) / max(1, n))
    k, shared = len(voters), docs.sparkSession.sparkContext.broadcast(voters)

    def vote(values: list[bytes]) -> dict[str, list]:
        return {"votes": [shared.value.read(t)[0] for t in values]}

    patterns = work.write(annotate(texts.select("text"), "text", "votes array<int>", vote).groupBy("votes").agg(F.count("*").alias("n")), "votes")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in small_slices(batches, "text"):
            read = [shared.value.read(t) for t in as_bytes(batch, "text")]
            yield {"votes": [v for v, _ in read], "toxic": batch.column(1).to_pylist(), "grams": [list(s) for _, s in read], "shares": [list(s.values()) for _, s in read]}

    start = np.full((2, k), 0.005)
    start[1] = 0.05
    base = float(np.clip((toxic or 0) / max(1, n), 0.01, 0.5)) if n else 0.05
    if not 0 < (toxic or 0) < n:  # nothing to train on: the generative model itself
        model = fit_label_model(patterns, LabelModel(start, base, np.ones(k)), False)
        on = model.weight * (np.log(model.fires[1] / model.fires[0]) - SILENCE * np.log((1 - model.fires[1]) / (1 - model.fires[0])))
        work.drop()
        return Toxicity(voters, on, np.zeros(len(voters.grams)), float(model.logits(np.zeros((1, k)))[0]))
    schema = "votes array<int>, toxic int, grams array<int>, shares array<float>"
    train = rows.mapInArrow(arrow_rows(schema, make), schema).toArrow().combine_chunks()  # at most `sample` rows
    votes, truth = dense(train["votes"].chunk(0), k), train["toxic"].to_numpy()
    for y in (0, 1):
        start[y] = (votes[truth == y].sum(0) + 2 * start[y]) / ((truth == y).sum() + 2)
    start[1] = np.maximum(start[1], start[0])
    model = fit_label_model(patterns, LabelModel(start, base, np.ones(k)), True)
    target = model.posterior(votes, np.where(truth == 1, 1, -1) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)))
    grams = train["grams"].chunk(0)
    out = train_linear(votes, np.diff(np.asarray(grams.offsets)), np.asarray(grams.flatten()), np.asarray(train["shares"].chunk(0).flatten()), len(voters.grams), target)
    work.drop()
    return Toxicity(voters, *out)


def scored(docs: DataFrame, text_col: str, model: Toxicity, score_col: str) -> DataFrame:
    """docs with their scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, text_col, f"`{score_col}` double", lambda values: {score_col: [shared.value.score(t) for t in values]})


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learned from: one in five by the CRC-32 of the id's text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels.where(~held_out(id_col)), id_col, text_col, **how)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    return scored(rows, "text", model, "score").select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_mild(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with a score under 0.5, with all their columns and whole texts."""
    model, score = fit(docs, labels.where(~held_out(id_col)), id_col, text_col, **how), fresh("__lf_score", docs)
    return scored(docs, text_col, model, score).where(F.col(score) < 0.5).drop(score)

"""A hidden Markov language model: trained by Baum and Welch, scored by the scaled forward recursion.

Hidden states emit cells. A token's cell is a part of its hash, so the tables of the model have the
same size for any corpus; within its cell a known token has the share of its count. The text
end has a cell of its own, and so has any token that training did not see, with the mass of half a
token. Counts of tokens cover all training texts; every Baum-Welch round runs over all
of them, and tasks send expected counts by cell, never by token or text. The states start from a
mixture of unigrams that is fitted to all training texts as well, and no text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import picked, stored
from plumbline.llm.words import SPACED, Powers, slices, words_of

STATES = 6
CELL_BITS = 16
CELLS = 1 << CELL_BITS
END_CELL, NEW_CELL = CELLS, CELLS + 1
END = np.uint64(0x8000000000000001)
#: Rounds go on until one raises the training texts' mean log-likelihood of a token by less than this (natural logarithm).
TOLERANCE = 1e-3
#: Texts are scored in chunks of about so many bytes, each with the counts of its own tokens.
CHUNK_BYTES = 8 << 20
STICK = 0.95
PRIOR = 100.0


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (cells + 2, states)
    cell_tokens: np.ndarray  # training tokens by cell
    tokens: int
    types: int

    @property
    def new(self) -> float:
        """Probability of the one slot for tokens that training did not see."""
        return 0.5 / (self.tokens + 0.5 * (self.types + 1))


def held_out(doc_id):
    """Rows without id are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens_of(texts, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each closed by the end, and the n + 1 places where rows begin."""
    found = words_of(texts, SPACED, powers=powers)
    hashes = np.where(found.hashes == END, END + np.uint64(1), found.hashes)
    return np.insert(hashes, found.first[1:], END), found.first + np.arange(len(found.first))


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return np.where(hashes == END, END_CELL, (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64))


def count(batches) -> Iterator[pa.RecordBatch]:
    """(token, n) of a task's texts, summed as far as a few million distinct tokens allow."""
    powers = Powers()
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed():
        token, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return token, np.bincount(place, weights=np.concatenate([h[1] for h in held])).astype(np.int64)

    def row(token, n):
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    for batch in slices(batches):
        token, n = np.unique(tokens_of(batch.column("text"), powers)[0], return_counts=True)
        held.append((token, n))
        if sum(len(h[0]) for h in held) > 1 << 20:
            held = [summed()]
            if len(held[0][0]) > 1 << 19:
                yield row(*held.pop())
    if held:
        yield row(*summed())


# -- training ----------------------------------------------------------------------------------


def stretches(first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of pieces of at most ``most`` tokens, longest first."""
    sizes = np.diff(first)
    pieces = -(-sizes // most)
    row = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = first[row] + nth * most
    length = np.minimum(most, first[row + 1] - at)
    order = np.argsort(-length, kind="stable")
    return at[order], length[order]


def active(length: np.ndarray) -> np.ndarray:
    """How many of the pieces, longest first, are longer than t, for every step t."""
    return np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")


def expect(cells: np.ndarray, first: np.ndarray, m: Model, out: dict[str, np.ndarray]) -> float:
    """Add the expected starts, moves and emissions of these texts to ``out``; returns their log-likelihood."""
    at, length = stretches(first, max(1, int(np.diff(first).max(initial=0))))
    start, move, emit = (x.astype(np.float32) for x in (m.start, m.move, m.emit))
    gamma = np.empty((len(cells), len(start)), dtype=np.float32)
    scale = np.empty((len(cells), 1), dtype=np.float32)
    alive = active(length)
    now = np.zeros((0, len(start)), dtype=np.float32)
    for t, n in enumerate(alive):
        place = at[:n] + t
        now = (start if t == 0 else now[:n] @ move) * emit[cells[place]]
        scale[place] = now.sum(axis=1, keepdims=True)
        now = now / scale[place]
        gamma[place] = now
    moves = np.zeros_like(m.move)
    beta = np.ones((0, len(start)), dtype=np.float32)
    for t in range(len(alive) - 1, -1, -1):
        place = at[: alive[t]] + t
        later = place[: len(beta)] + 1
        weight = beta * emit[cells[later]] / scale[later]
        moves += gamma[place[: len(beta)]].T @ weight
        beta = np.concatenate([weight @ move.T, np.ones((alive[t] - len(beta), len(start)), dtype=np.float32)])
        both = gamma[place] * beta
        gamma[place] = both / both.sum(axis=1, keepdims=True)
        if t == 0:
            out["start"] += gamma[place].sum(axis=0)
    out["move"] += moves * m.move
    for k in range(len(start)):
        out["emit"][:, k] += np.bincount(cells, weights=gamma[:, k], minlength=CELLS + 2)
    return float(np.log(scale, dtype=np.float64).sum())


def summed_rows(out: dict[str, np.ndarray], likelihood: float) -> pa.RecordBatch:
    """(kind, place, values) of a task; the driver sums at most one row for each cell. The likelihood is in 64 bits."""
    states = out["emit"].shape[1]
    kinds, places, values = [], [], []
    for kind, v in out.items():
        some = np.flatnonzero(v.any(axis=1))
        kinds += [kind] * len(some)
        places.append(some)
        values.append(v[some])
    places, values = np.concatenate([*places, [0]]), np.concatenate([*values, np.zeros((1, states))])
    like = np.zeros(len(places))
    like[-1] = likelihood
    columns = [pa.array([*kinds, "like"]), pa.array(places, pa.int32()), *[pa.array(values[:, k].astype(np.float32)) for k in range(states)], pa.array(like)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "place", *[f"s{k}" for k in range(states)], "like"])


def expected(batches, m: Model) -> Iterator[pa.RecordBatch]:
    """A task's expected counts and log-likelihood."""
    powers, states, likelihood = Powers(), len(m.start), 0.0
    out = {"start": np.zeros((1, states)), "move": np.zeros((states, states)), "emit": np.zeros((CELLS + 2, states))}
    for batch in slices(batches):
        hashes, first = tokens_of(batch.column("text"), powers)
        one = {"start": out["start"][0], "move": out["move"], "emit": out["emit"]}
        likelihood += expect(cells_of(hashes), first, m, one)
    yield summed_rows(out, likelihood)


def normal(counts: np.ndarray, prior: np.ndarray | float, axis: int) -> np.ndarray:
    filled = counts + prior
    total = filled.sum(axis=axis, keepdims=True)
    return np.divide(filled, total, out=np.zeros_like(filled), where=total > 0)


def refit(m: Model, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    """Probabilities from expected counts. Cells lean to their share of all tokens, so that every
    cell training met can be emitted anywhere; the unseen slot has its fixed mass in every state."""
    share = m.cell_tokens / max(1, m.tokens)
    cells = normal(emit, PRIOR * share[:, None], 0) * (1 - m.new)
    cells[NEW_CELL] = m.new
    return Model(normal(start, 1.0, 0), normal(move, 1.0, 1), cells, m.cell_tokens, m.tokens, m.types)


def lifts(part: np.ndarray, share: np.ndarray) -> np.ndarray:
    """(cells + 2, components): log of each cell's probability in a component over its share of all tokens."""
    probability = (part + PRIOR * share[:, None]) / (part.sum(axis=0) + PRIOR)
    return np.log(np.divide(probability, share[:, None], out=np.ones_like(part), where=share[:, None] > 0))


def by_text(cells: np.ndarray, first: np.ndarray, lift: np.ndarray) -> np.ndarray:
    return np.add.reduceat(lift[cells], first[:-1], axis=0)


def farthest(batches, lift: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lift, text) of the task's text that the components so far explain worst; the longest if there are none."""
    powers, best = Powers(), None
    for batch in slices(batches):
        hashes, first = tokens_of(batch.column("text"), powers)
        if len(first) > 1:
            far = by_text(cells_of(hashes), first, lift).max(axis=1) if lift.shape[1] else -np.diff(first).astype(float)
            least = far.min()
            if best is None or least <= best[0]:
                own = min(batch.column("text")[int(i)].as_py() or "" for i in np.flatnonzero(far == least))
                best = min(best or (least, own), (least, own))
    if best is not None:
        yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]])], names=["lift", "text"])


def mixed(batches, lift: np.ndarray, log_weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's expected counts, texts of each component (start) and log-likelihood under a mixture of unigrams."""
    powers, states, likelihood = Powers(), lift.shape[1], 0.0
    out = {"start": np.zeros((1, states)), "emit": np.zeros((CELLS + 2, states))}
    for batch in slices(batches):
        hashes, first = tokens_of(batch.column("text"), powers)
        if len(first) < 2:
            continue
        cells = cells_of(hashes)
        score = by_text(cells, first, lift) + log_weight
        top = score.max(axis=1, keepdims=True)
        weight = np.exp(score - top)
        total = weight.sum(axis=1, keepdims=True)
        likelihood += float((top + np.log(total)).sum())
        weight /= total
        out["start"] += weight.sum(axis=0)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for k in range(states):
            out["emit"][:, k] += np.bincount(cells, weights=weight[row, k], minlength=CELLS + 2)
    yield summed_rows(out, likelihood)


def gathered(texts: DataFrame, task, states: int) -> tuple[dict[str, np.ndarray], float]:
    """The sums over all tasks: at most one row for each cell and state comes to the driver."""
    columns = ", ".join(f"s{k} float" for k in range(states))
    rows = texts.select("text").mapInArrow(task, f"kind string, place int, {columns}, like double")
    out = {"start": np.zeros((1, states)), "move": np.zeros((states, states)), "emit": np.zeros((CELLS + 2, states))}
    likelihood = 0.0
    for r in rows.groupBy("kind", "place").agg(*[F.sum(f"s{k}") for k in range(states)], F.sum("like")).collect():
        if r[0] == "like":
            likelihood = r[-1]
        else:
            out[r[0]][r[1]] = r[2:-1]
    return out, likelihood


def mixture(texts: DataFrame, share: np.ndarray, tokens: int, states: int) -> np.ndarray:
    """Expected cells (cells + 2, states) of a mixture of unigrams over all texts, each component seeded by the text the others explain worst."""
    context = texts.sparkSession.sparkContext
    part = np.zeros((CELLS + 2, 0))
    for _ in range(states):
        shared = context.broadcast(lifts(part, share))
        far = texts.select("text").mapInArrow(lambda it, shared=shared: farthest(it, shared.value), "lift double, text string")
        text = far.agg(F.min(F.struct("lift", "text"))["text"]).first()[0]
        cells = cells_of(tokens_of(pa.array([text], pa.string()), Powers())[0])
        part = np.column_stack([part, np.bincount(cells, minlength=CELLS + 2)])
        shared.unpersist()
    log_weight, before = np.zeros(states) - np.log(states), -np.inf
    while True:
        shared = context.broadcast((lifts(part, share), log_weight))
        out, likelihood = gathered(texts, lambda it, shared=shared: mixed(it, *shared.value), states)
        shared.unpersist()
        part, log_weight = out["emit"], np.log(out["start"][0] / out["start"].sum() + 1e-9)
        if likelihood - before < TOLERANCE * tokens:
            return part
        before = likelihood


def train(texts: DataFrame, states: int = STATES, rounds: int | None = None) -> tuple[Model, DataFrame]:
    """The model, and the table (token, n) of all training tokens. ``texts`` has doc_id and text.

    Baum-Welch rounds go on until they gain less than TOLERANCE, or for ``rounds`` rounds if the caller names a number.
    """
    spark = texts.sparkSession
    counts = texts.select("text").mapInArrow(count, "token bigint, n bigint")
    vocabulary = stored(counts.groupBy("token").agg(F.sum("n").alias("n")), "vocabulary")
    by_cell = vocabulary.groupBy(F.when(F.col("token") == int(END.view(np.int64)), END_CELL).otherwise(F.shiftrightunsigned("token", 64 - CELL_BITS)).cast("int").alias("cell"))
    cell_tokens, types = np.zeros(CELLS + 2), 0
    for r in by_cell.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():  # one row for each cell
        cell_tokens[r["cell"]] = r["n"]
        types += r["types"]
    tokens = int(cell_tokens.sum())
    share = cell_tokens / max(1, tokens)

    emit = mixture(texts, share, tokens, states) if tokens else np.zeros((CELLS + 2, states))
    model = Model(np.zeros(states), np.zeros((states, states)), emit, cell_tokens, tokens, types)
    model = refit(model, emit.sum(axis=0), np.zeros((states, states)), emit)
    model.move = np.full((states, states), (1 - STICK) / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(model.move, STICK if states > 1 else 1.0)
    done, before = 0, -np.inf
    while tokens and done != rounds:
        shared = spark.sparkContext.broadcast(model)
        out, likelihood = gathered(texts, lambda it, shared=shared: expected(it, shared.value), states)
        shared.unpersist()
        model = refit(model, out["start"][0], out["move"], out["emit"])
        done += 1
        if rounds is None and likelihood - before < TOLERANCE * tokens:
            break
        before = likelihood
    return model, vocabulary


# -- scoring -----------------------------------------------------------------------------------


def forward(cells: np.ndarray, first: np.ndarray, m: Model) -> np.ndarray:
    """Natural logarithm of the probability of each row's cells: the scales of alpha multiply up to it."""
    order = np.argsort(-np.diff(first), kind="stable")
    at, length = first[:-1][order], np.diff(first)[order]
    total = np.zeros(len(at))
    now = np.zeros((0, len(m.start)))
    for t, n in enumerate(active(length)):
        now = (m.start if t == 0 else now[:n] @ m.move) * m.emit[cells[at[:n] + t]]
        s = now.sum(axis=1)
        now = now / s[:, None]
        total[:n] += np.log(s)
    out = np.empty(len(at))
    out[order] = total
    return out


def scored(texts, token: np.ndarray, n: np.ndarray, m: Model, powers: Powers) -> list[np.ndarray]:
    """(n_tokens, n_known, base, score) by row; token, sorted, and n are what training counted of them."""
    hashes, first = tokens_of(texts, powers)
    where = np.searchsorted(token, hashes)
    known = np.zeros(len(hashes), dtype=bool)
    inside = where < len(token)
    known[inside] = token[where[inside]] == hashes[inside]
    c = np.zeros(len(hashes))
    c[known] = n[where[known]]
    cells = np.where(known, cells_of(hashes), NEW_CELL)
    within = np.zeros(len(hashes))
    within[known] = np.log10(c[known] / m.cell_tokens[cells[known]])
    base = np.log10((c + 0.5) / (m.tokens + 0.5 * (m.types + 1)))
    by_row = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else x[:0]
    return [np.diff(first), by_row(known.astype(np.int64)), by_row(base), forward(cells, first, m) / np.log(10) + by_row(within)]


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores of rows (doc_id, held_out, text). Texts lie in chunks by hash; a chunk's
    distinct tokens fetch their counts, and meet the chunk's texts again. A token that more than one
    batch of the chunk asks for comes back as often, which does no harm."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    placed = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartition("chunk")

    def distinct(batches):
        powers = Powers()
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            hashes, first = tokens_of(batch.column("text"), powers)
            of = np.repeat(chunk, np.diff(first))
            for c in np.unique(chunk):
                token = np.unique(hashes[of == c])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), c), pa.int32()), pa.array(token.view(np.int64))], names=["chunk", "token"])

    uses = placed.select("chunk", "text").mapInArrow(distinct, "chunk int, token bigint")
    counts = uses.join(vocabulary, "token").select("chunk", "token", "n")
    shared = spark.sparkContext.broadcast(model)
    id_type = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        m = shared.value
        token, n = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
        order = np.argsort(token)
        n_tokens, n_known, base, likely = scored(texts.column("text"), token[order], n[order], m, Powers())
        made = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([m.tokens] * len(n_tokens), pa.int64()), pa.array(base), pa.array(likely)]
        return pa.table([texts.column("doc_id"), texts.column("held_out"), *made], names=names)

    schema = f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return placed.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(run, schema)


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int | None = None) -> DataFrame:
    """Every row's log10 probability under the model and under the smoothed unigram base.

    Trains on the rows whose crc32(id as text) mod 5 is not 1. Null and empty texts are just the
    end. Rows without id train and are scored; a repeated row counts and is returned as
    often as it comes. With no training rows at all, every token has the unseen slot's mass, 1.
    """
    wanted = picked(docs, {"doc_id": id_col, "text": text_col}, {"text": "string"}).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    model, vocabulary = train(wanted.where("NOT held_out").select("doc_id", "text"), states, rounds)
    return score(wanted, model, vocabulary)


def op5_language_model(spark, sf: str) -> DataFrame:
    return language_model(spark.read.parquet(f"{sf}/documents.parquet"))

"""Spelling variants: the vocabulary's acceptor, composed with one edit and with itself.

Words are dealt to partitions that share the states an acceptor reaches from its initial state
by half of a word: the first half, or, for words read backwards, the last half.  One edit leaves
one of the halves alone.  Pairs are looked for by the length of the shorter word, so a word is in
four partitions: with words of its length and of one more, read forwards and backwards.  An edit
behind the first half is found forwards, one within it backwards, none twice.

A task builds the minimal acceptor of some whole partitions, each with initial states of its own:
states are equal if they have the same arcs.  Each arc holds how many words come before it, so a
path through the acceptor adds up to the number of its word.  The composition walks pairs of states
of both acceptors and the state of the transducer (no edit yet, or one): after the shared half, an
arc may be replaced by a later one, or left out of the longer word; from then on both walk the
same letters.  A letter of a run counts as deleted at the end of the run, once.

A partition of more words than a task should hold is cut into blocks, and each pair of blocks is
composed in a task of its own.  Only the number of near words and the best of them leave a task.

A null text has no words; a null doc_id counts as an empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandkit.llm.common import arrow_rows, prepare
from strandkit.session import reliable_checkpoint

# Fixed values of the contract.
LETTERS, LEAST_LENGTH, LEAST_COUNT, RATIO, EVERY = r"[A-Za-zÀ-ÿ]", 7, 2, 10, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words, and letters, that a task composes at once; larger partitions are cut.
CHUNK_WORDS, CHUNK_LETTERS = 30_000, 1_000_000
FORWARDS, BACKWARDS = 0, 1


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of ``LEAST_LENGTH`` letters seen ``LEAST_COUNT`` times or more."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS + f"{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"),
    ).withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat_ws(":", "doc", "run"))
    cut = F.pmod(F.col("h"), F.length("run")).cast("int")
    word = F.when(F.col("h") % EVERY == 0, F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))).otherwise(F.col("run"))
    words = runs.withColumn("h", h).withColumn("at", cut).select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


# -- partitions --------------------------------------------------------------------

def partitions(words: DataFrame, chunk_words: int = CHUNK_WORDS, chunk_letters: int = CHUNK_LETTERS) -> DataFrame:
    """(gid, way, len, part, kind, word, n, block): each word in its partitions, letters in reading order.

    ``len`` is the shorter length of a pair, ``kind`` 0 for words of that length and 1 for longer ones,
    ``part`` the pair of blocks (block of x + number of blocks * block of y, x <= y) of a cut partition."""
    ways = F.array(*[
        F.struct(F.lit(way).alias("way"), F.lit(kind).alias("kind"), (F.length("word") - kind).cast("int").alias("len"))
        for way in (FORWARDS, BACKWARDS) for kind in (0, 1)
    ])
    dealt = words.select("word", "n", F.explode(ways).alias("w")).select("word", "n", "w.*").filter(F.col("len") >= LEAST_LENGTH)
    dealt = dealt.withColumn("word", F.when(F.col("way") == BACKWARDS, F.reverse("word")).otherwise(F.col("word")))
    key = F.expr("substring(word, 1, case when way = 0 then len div 2 else len - len div 2 end)")
    dealt = dealt.withColumn("gid", F.xxhash64("way", "len", key))
    most = F.least(F.lit(chunk_words), F.greatest(F.lit(1), F.lit(chunk_letters) / F.col("len")))
    large = dealt.groupBy("gid", "way", "len").agg(F.count(F.lit(1)).alias("size")).withColumn(
        "blocks", F.ceil(F.col("size") / most).cast("int")
    ).filter(F.col("blocks") > 1).drop("size")
    # few partitions are large: by their number, not by assumption, Spark chooses the join
    dealt = dealt.join(large, ["gid", "way", "len"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    pairs = F.expr("transform(sequence(0, blocks - 1), o -> least(block, o) + blocks * greatest(block, o))")
    return dealt.withColumn("part", F.explode(pairs)).withColumn("diagonal", F.col("part") % F.col("blocks") == F.floor(F.col("part") / F.col("blocks")))


# -- acceptor ----------------------------------------------------------------------

class Acceptor:
    """Minimal acceptor of sorted distinct words under several initial states.

    ``letters``: code points, one row per word, zero behind its end; ``root``: number of the initial
    state, not decreasing; all words of an initial state have the same length."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray, root: np.ndarray):
        n, width = letters.shape
        same = np.zeros(n, dtype=np.int64)  # letters shared with the row before
        if n > 1:
            equal = letters[1:] == letters[:-1]
            same[1:] = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
        fresh_root = np.r_[True, root[1:] != root[:-1]]
        same[fresh_root] = -1  # a new initial state: nodes from depth 0 on
        known: dict[bytes, int] = {b"": 0}
        arcs: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
        counts: list[int] = [1]
        below = None
        for depth in range(width, -1, -1):
            rows = np.flatnonzero((same < depth) & (lengths >= depth))  # first rows of the nodes of this depth
            state = np.zeros(len(rows), dtype=np.int64)
            if below is not None and len(below[0]):
                child_rows, child_state = below
                code = (letters[child_rows, depth].astype(np.int64) << 40) | child_state
                parent = np.searchsorted(rows, child_rows, side="right") - 1
                has = np.unique(parent)
                starts = np.searchsorted(parent, has)
                ends = np.r_[starts[1:], len(parent)]
                raw = code.tobytes()
                ids = np.empty(len(has), dtype=np.int64)
                for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                    sign = raw[8 * a:8 * b]
                    got = known.get(sign)
                    if got is None:
                        got = known[sign] = len(arcs)
                        arcs.append(code[a:b])
                        counts.append(sum(counts[c] for c in child_state[a:b].tolist()))
                    ids[i] = got
                state[has] = ids
            below = (rows, state)
        self.roots, self.base = below[1], below[0]  # rows of depth 0 are the first rows of the initial states
        sizes = np.array([len(a) for a in arcs])
        code = np.concatenate(arcs)
        self.first = np.r_[0, np.cumsum(sizes)]
        self.owner = np.repeat(np.arange(len(arcs)), sizes)
        self.letter, self.target = code >> 40, code & ((1 << 40) - 1)
        held = np.array(counts)[self.target]
        before = np.r_[0, np.cumsum(held)]
        self.skip = before[:-1] - before[self.first[self.owner]]  # words before this arc of its state
        self.key = (self.owner << 21) | self.letter
        self.n_states = len(arcs)

    def arcs_of(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All arcs of each state: (row of the state, arc)."""
        lengths = self.first[states + 1] - self.first[states]
        row = np.repeat(np.arange(len(states)), lengths)
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return row, self.first[states][row] + inside

    def same_letter(self, states: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arc of each state with this letter: (rows that have one, arc)."""
        wanted = (states << 21) | letters
        at = np.searchsorted(self.key, wanted)
        hit = np.flatnonzero(self.key[np.minimum(at, len(self.key) - 1)] == wanted) if len(self.key) else np.zeros(0, dtype=np.int64)
        return hit, at[hit]


def compose(acc: Acceptor, left: np.ndarray, right: np.ndarray, shared: np.ndarray, length: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of accepted pairs.

    ``left`` and ``right``: numbers of initial states; ``length`` that of the words on the right, ``shared`` the
    letters before the edit at least.  ``longer``: a letter of the left word is left out, else one is replaced
    by a later one (left and right are the same states then)."""
    x, y = acc.roots[left], acc.roots[right]
    i, j = acc.base[left], acc.base[right]
    depth = 0
    none = np.zeros(0, dtype=np.int64)
    edited = [none] * 5  # states, word numbers, letter that must not come next
    left_out, right_out = [none], [none]
    while len(x) or len(edited[0]):
        # with one edit made, both read the same letters
        ex, ey, ei, ej, ban = edited
        ended = acc.first[ex + 1] == acc.first[ex]
        left_out.append(ei[ended])
        right_out.append(ej[ended])
        ex, ey, ei, ej, ban = ex[~ended], ey[~ended], ei[~ended], ej[~ended], ban[~ended]
        row, arc = acc.arcs_of(ex)
        fine = acc.letter[arc] != ban[row]
        row, arc = row[fine], arc[fine]
        hit, other = acc.same_letter(ey[row], acc.letter[arc])
        row, arc = row[hit], arc[hit]
        moved = [acc.target[arc], acc.target[other], ei[row] + acc.skip[arc], ej[row] + acc.skip[other], np.full(len(row), -1)]
        # the edit itself, behind the shared letters
        may = np.flatnonzero(shared <= depth)
        row, arc = acc.arcs_of(x[may])
        row = may[row]
        if longer:
            fresh = [acc.target[arc], y[row], i[row] + acc.skip[arc], j[row], acc.letter[arc]]
        else:
            later = acc.first[x[row] + 1] - arc - 1
            twice = np.repeat(np.arange(len(row)), later)
            other = arc[twice] + 1 + np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
            arc, row = arc[twice], row[twice]
            fresh = [acc.target[arc], acc.target[other], i[row] + acc.skip[arc], j[row] + acc.skip[other], np.full(len(row), -1)]
        if longer:
            # a deletion reads one letter of the left word only: its pair is at the same depth as before,
            # and must read on in this step
            ended = acc.first[fresh[0] + 1] == acc.first[fresh[0]]
            left_out.append(fresh[2][ended])
            right_out.append(fresh[3][ended])
            fx, fy, fi, fj, ban = (f[~ended] for f in fresh)
            row2, arc2 = acc.arcs_of(fx)
            fine = acc.letter[arc2] != ban[row2]
            row2, arc2 = row2[fine], arc2[fine]
            hit, other = acc.same_letter(fy[row2], acc.letter[arc2])
            row2, arc2 = row2[hit], arc2[hit]
            fresh = [acc.target[arc2], acc.target[other], fi[row2] + acc.skip[arc2], fj[row2] + acc.skip[other], np.full(len(row2), -1)]
        edited = [np.concatenate(p) for p in zip(moved, fresh)]
        # without an edit, both read the same letters too
        row, arc = acc.arcs_of(x)
        if longer:
            hit, other = acc.same_letter(y[row], acc.letter[arc])
            row, arc = row[hit], arc[hit]
        else:
            other = arc
        x, y, i, j = acc.target[arc], acc.target[other], i[row] + acc.skip[arc], j[row] + acc.skip[other]
        shared = shared[row]
        depth += 1
    return np.concatenate(left_out), np.concatenate(right_out)


# -- tasks -------------------------------------------------------------------------

OUT_SCHEMA = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])
COLUMNS = ["gid", "way", "len", "part", "kind", "block", "diagonal", "n", "word"]


def _near(rows: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """Near words of the rows of whole partitions, sorted by (gid, way, len, part, kind, word)."""
    words = rows["word"]
    n = len(words)
    width = max(map(len, words))
    letters = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(n, width).astype(np.int64)
    lengths = rows["len"] + rows["kind"]
    change = lambda *names: np.r_[True, np.any([rows[c][1:] != rows[c][:-1] for c in names], axis=0)]
    new_part = change("gid", "way", "len", "part")
    new_root = change("gid", "way", "len", "part", "kind")
    root = np.cumsum(new_root) - 1
    acc = Acceptor(letters, lengths, root)
    heads = np.flatnonzero(new_root)
    part_of_root = (np.cumsum(new_part) - 1)[heads]
    kind, way, length = rows["kind"][heads], rows["way"][heads], rows["len"][heads]
    shared = np.where(way == FORWARDS, length // 2, length - length // 2)
    same = np.flatnonzero(kind == 0)
    a, b = compose(acc, same, same, shared[same], length[same], longer=False)
    over = np.flatnonzero((kind[1:] == 1) & (part_of_root[1:] == part_of_root[:-1])) + 1  # the shorter words stand before
    c, d = compose(acc, over, over - 1, shared[over], length[over], longer=True)
    # backwards, a deletion may also be read behind the first half: found forwards then
    back = rows["way"][c] == BACKWARDS
    if back.any():
        u, v, size = c[back], d[back], rows["len"][c[back]]
        half = size // 2
        forwards = np.ones(len(u), dtype=bool)
        for t in range(int(half.max())):
            forwards &= (t >= half) | (letters[u, size - t] == letters[v, np.maximum(size - 1 - t, 0)])
        keep = np.ones(len(c), dtype=bool)
        keep[np.flatnonzero(back)[forwards]] = False
        c, d = c[keep], d[keep]
    a, b = np.r_[a, c], np.r_[b, d]
    cross = rows["diagonal"][a] | (rows["block"][a] != rows["block"][b])  # pairs inside a block belong to its own task
    a, b = a[cross], b[cross]
    # each word once per chunk, in the order of code points
    plain = np.array([w[::-1] if k else w for w, k in zip(words, (rows["way"] == BACKWARDS).tolist())], dtype=object)
    distinct, first, rank = np.unique(plain, return_index=True, return_inverse=True)
    counts = rows["n"][first]
    own, other = rank[np.r_[a, b]], rank[np.r_[b, a]]
    order = np.lexsort((other, -counts[other], own))
    own, other = own[order], other[order]
    near = np.bincount(own, minlength=len(distinct))
    best = np.full(len(distinct), -1)
    lead = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, dtype=np.int64)
    best[own[lead]] = other[lead]
    home = np.zeros(len(distinct), dtype=bool)
    home[rank[(rows["way"] == FORWARDS) & (rows["kind"] == 0) & rows["diagonal"]]] = True
    out = np.flatnonzero(home | (near > 0))
    none = best[out] < 0
    return arrow_rows({
        "word": pa.array(distinct[out], pa.string()), "n": counts[out], "n_near": near[out],
        "form_n": pa.array(counts[best[out]], pa.int64(), mask=none), "form": pa.array(distinct[best[out]], pa.string(), mask=none),
    }, OUT_SCHEMA)


def _chunks(batches: Iterator[pa.RecordBatch], chunk_words: int, chunk_letters: int) -> Iterator[dict[str, np.ndarray]]:
    """Rows of whole partitions, about as many as a task composes at once."""
    held: pa.Table | None = None

    def rows(table: pa.Table) -> dict[str, np.ndarray]:
        out = {c: table[c].to_numpy() for c in COLUMNS[:-1]}
        out["word"] = table["word"].to_pylist()
        return out

    def cuts(table: pa.Table) -> np.ndarray:
        keys = [table[c].to_numpy() for c in COLUMNS[:4]]
        return np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch.select(COLUMNS)])
        held = table if held is None else pa.concat_tables([held, table])
        while True:
            width = 1 + max(held["len"].to_numpy().max(), 1)
            if held.num_rows <= min(chunk_words, max(1, chunk_letters // width)):
                break
            at = cuts(held)
            if not len(at):
                break  # one partition so far
            # whole partitions up to the limit, and one at least; the last may go on in the next batch
            sizes = np.maximum.accumulate(held["len"].to_numpy())[at - 1] + 1
            fits = at[(at <= chunk_words) & (at * sizes <= chunk_letters)]
            end = int(fits[-1]) if len(fits) else int(at[0])
            yield rows(held.slice(0, end))
            held = held.slice(end)
    if held is not None and held.num_rows:
        yield rows(held)


def near_words(words: DataFrame, chunk_words: int = CHUNK_WORDS, chunk_letters: int = CHUNK_LETTERS) -> DataFrame:
    """(word, n, n_near, form_n, form): the number of near words, and the one of largest n
    (ties: the first by code points)."""
    spark = prepare(words.sparkSession)
    order = ["gid", "way", "len", "part", "kind", "word"]
    dealt = partitions(words, chunk_words, chunk_letters).select(*COLUMNS).repartition("gid", "part").sortWithinPartitions(*order)

    def run(batches):
        for rows in _chunks(batches, chunk_words, chunk_letters):
            yield _near(rows)

    found = dealt.mapInArrow(run, "word string, n bigint, n_near bigint, form_n bigint, form string")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n", "n_near", (-F.col("b.less")).alias("form_n"), F.col("b.form").alias("form")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each round doubles the steps followed.

    A form is ten times as frequent as its word, so no chain has more than 18 steps: five rounds at most."""
    now = reliable_checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        nxt = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = reliable_checkpoint(now.join(nxt, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if not moved.filter("moved").head(1):
            return now


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the vocabulary."""
    prepare(docs.sparkSession)
    words = reliable_checkpoint(vocabulary(docs, id_col, text_col))
    near = near_words(words)
    formed = F.col("form_n").cast("decimal(20,0)") >= F.col("n").cast("decimal(20,0)") * RATIO
    marked = reliable_checkpoint(near.withColumn("form", F.when(formed, F.col("form"))).withColumn("form_n", F.when(formed, F.col("form_n"))))
    chains = roots(marked.filter("form is not null"))
    return marked.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""N-gram Jaccard similarity join with rare-first prefix, length, positional and suffix filters.

1. Documents with the same shingle set form one class, known by a 64-bit digest of the set;
   classes that a second digest tells apart get ids of their own.
2. Frequencies: each run of documents counts its shingles (56-bit hashes), and the counts, as
   sorted, delta-coded blocks, are summed by ranges of the hash space. Only shingles counted
   twice or more are kept. A hot shingle is one entry per run here.
3. Classes get the frequencies of their shingles in the same ranges: a range's frequencies come
   first, then the classes' blocks stream by and are looked up, so a task holds its frequencies
   and one block, however hot a shingle is. A shingle counted once can't be shared, so it leads
   each rare-first order and is known by its number alone: a class whose repeated shingles are
   fewer than the least overlap has no candidate and goes at once.
4. The join is on the shingles of the prefixes. Each prefix shingle of two classes or more is
   named by its pivot, the least class that has it in its prefix, and classes meet in the buckets
   of their pivots: shingles that stand together share a pivot, so copies of one text meet in a
   few buckets, not in one for each shingle they share. Nothing else brings classes together.
5. Buckets are dealt into blocks by size class and hash, bounded in members and shingles, so
   hot ones are split; each pair of blocks whose size classes can meet is one task. There a pair
   with a common prefix shingle of this pivot, and none of a lesser one (it is done there),
   passes the length, positional and suffix filters and is verified once, by its exact overlap.
   A task returns a row per class, never the pairs.
6. Components of the verified links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .known import forget
from .shared import bounded_batches, dropped, partitions, written

#: Members and shingles of a block, at most as the mean over a bucket's size class.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 1 << 18
#: Shingles that a task sorts at once before it sends blocks on, and those of a range of the hash space.
RUN, RANGE = 1 << 20, 1 << 21
_U = np.uint64


def _shingles(w: W.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a chunk: document and 56-bit hash, ordered by both."""
    rolling = W.Rolling(w.hashes())
    starts = W.window_starts(w.first, n)
    short = np.flatnonzero((w.n > 0) & (w.n < n))
    h = np.concatenate([rolling.at(starts, n), rolling.at(w.first[short], w.n[short])]) >> _U(8)
    doc = np.concatenate([np.searchsorted(w.first, starts, "right") - 1, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _digests(doc: np.ndarray, h: np.ndarray, docs: int, bits: int, clashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, and two digests of each document's set, the first of ``bits`` bits; the first takes in the second where it is in ``clashes``."""
    edges = np.searchsorted(doc, np.arange(docs + 1))
    n = np.diff(edges)
    sums = []
    for salt in (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D):
        x = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(W.mix(h ^ _U(salt)), out=x[1:])
        sums.append(x[edges[1:]] - x[edges[:-1]])
    a, b, c, d = sums
    first, second = W.mix(a + W.mix(b + n.astype(np.uint64))) >> _U(64 - bits), W.mix(c + W.mix(d + n.astype(np.uint64)))
    return n, np.where(np.isin(first, clashes), W.mix(first ^ W.mix(second)), first), second


def _sets(n: int, bits: int):
    none = np.zeros(0, np.uint64)

    def run(batches):
        forget()
        for batch in batches:
            sizes, digests, checks = [np.zeros(0, np.int64)], [none], [none]
            for _, data, offsets in W.chunks(batch["_text"]):
                w = W.Words(data, offsets, W.SPACES, lower=True)
                size, digest, check = _digests(*_shingles(w, n), len(w.n), bits, none)
                sizes.append(size)
                digests.append(digest)
                checks.append(check)
            yield pa.RecordBatch.from_pydict({"_id": batch["_id"], "n": pa.array(np.concatenate(sizes).astype(np.int64)), "set_id": pa.array(W.signed(np.concatenate(digests))), "check": pa.array(W.signed(np.concatenate(checks)))})

    return run


def _pack(x: np.ndarray) -> bytes:
    """Compressed byte planes of unsigned 64-bit values."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _runs(batches, n: int, bits: int, clashes: np.ndarray):
    """Class and shingle of runs of about RUN shingles; of a run's documents of one class only the first."""
    classes, shingles, held, seen = [], [], 0, np.zeros(0, np.uint64)
    for batch in batches:
        for _, data, offsets in W.chunks(batch["_text"]):
            w = W.Words(data, offsets, W.SPACES, lower=True)
            doc, h = _shingles(w, n)
            size, digest, _ = _digests(doc, h, len(w.n), bits, clashes)
            first = np.zeros(len(w.n), bool)
            first[np.unique(digest, return_index=True)[1]] = True
            first &= (size > 0) & ~np.isin(digest, seen)
            seen = np.concatenate([seen, digest[first]])
            keep = first[doc]
            classes.append(digest[doc][keep])
            shingles.append(h[keep])
            held += len(shingles[-1])
            if held >= RUN:
                yield np.concatenate(classes), np.concatenate(shingles)
                classes, shingles, held, seen = [], [], 0, np.zeros(0, np.uint64)
    if held:
        yield np.concatenate(classes), np.concatenate(shingles)


def _cut(h: np.ndarray, ranges: int) -> list[tuple[int, slice]]:
    """The ranges that sorted hashes fall into."""
    part = ((h >> _U(24)) * _U(ranges)) >> _U(32)
    cuts = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
    return [(k, slice(cuts[k], cuts[k + 1])) for k in np.flatnonzero(np.diff(cuts)).tolist()]


def _delta(h: np.ndarray) -> bytes:
    return _pack(np.concatenate([h[:1], np.diff(h)]))


def _rows(part: list, kind: int, shingles: list, values: list, ids: list) -> pa.RecordBatch:
    columns = {"part": pa.array(part, pa.int32()), "kind": pa.array([kind] * len(part), pa.int32())}
    return pa.RecordBatch.from_pydict(columns | {k: pa.array(v, pa.binary()) for k, v in (("shingles", shingles), ("vals", values), ("ids", ids))})


BLOCKS = "part int, kind int, shingles binary, vals binary, ids binary"


def _counts(n: int, ranges: int, bits: int, clashes: np.ndarray):
    """Blocks of shingles and how many of a run's documents hold each."""

    def run(batches):
        forget()
        for _, h in _runs(batches, n, bits, clashes):
            h, c = np.unique(h, return_counts=True)
            cuts = _cut(h, ranges)
            yield _rows([k for k, _ in cuts], 0, [_delta(h[s]) for _, s in cuts], [_pack(c[s]) for _, s in cuts], [b""] * len(cuts))

    return run


def _summed(batches):
    """The frequencies of a range's shingles that are counted twice or more."""
    shingles, counts, part = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
    for batch in batches:
        for p, s, v in zip(batch["part"].to_pylist(), batch["shingles"].to_pylist(), batch["vals"].to_pylist(), strict=True):
            part = p
            shingles.append(np.cumsum(_unpack(s)))
            counts.append(_unpack(v))
    h, c = np.concatenate(shingles), np.concatenate(counts)
    del shingles, counts
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    if len(start):
        h, c = h[start], np.add.reduceat(c, start)
        h, c = h[c > 1], c[c > 1]
        if len(h):
            yield _rows([part], 0, [_delta(h)], [_pack(c)], [b""])


def _ranges(n: int, ranges: int, bits: int, clashes: np.ndarray):
    """Blocks of shingles and the classes of a run that hold them."""

    def run(batches):
        forget()
        for classes, h in _runs(batches, n, bits, clashes):
            order = np.argsort(h)
            classes, h = classes[order], h[order]
            cuts, which, ids = _cut(h, ranges), [], []
            for _, s in cuts:
                own, place = np.unique(classes[s], return_inverse=True)
                which.append(_pack(place))
                ids.append(own.tobytes())
            yield _rows([k for k, _ in cuts], 1, [_delta(h[s]) for _, s in cuts], which, ids)

    return run


def _looked_up(batches):
    """The (class, shingle, frequency) rows of a range: first its frequencies come, then its blocks, one by one."""
    h, df = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for batch in batches:
        for kind, s, v, i in zip(*(batch[c].to_pylist() for c in ("kind", "shingles", "vals", "ids")), strict=True):
            if kind == 0:
                h, df = np.cumsum(_unpack(s)), _unpack(v)
            elif len(h):
                own = np.cumsum(_unpack(s))
                place = np.minimum(np.searchsorted(h, own), len(h) - 1)
                often = h[place] == own
                ids = np.frombuffer(i, np.uint64)[_unpack(v).astype(np.int64)[often]]
                yield pa.RecordBatch.from_pydict({"set_id": pa.array(W.signed(ids)), "shingle": pa.array(W.signed(own[often])), "df": pa.array(W.signed(df[place[often]]))})


def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    a, b = (x.to_numpy(np.int64).view(np.uint64) for x in (a, b))
    return pd.Series(W.signed(W.mix(a ^ W.mix(b))))


class _Side:
    """One block's classes: shingles as ranks in the global rare-first order."""

    def __init__(self, rows: dict, ranks: list[np.ndarray], percent: int):
        self.n, self.ids, self.copies = rows["n"], rows["set_id"], rows["copies"]
        self.ranks = ranks
        m = np.array([len(r) for r in ranks])
        self.prefix = m - -(-percent * self.n // 100) + 1
        self.last = np.array([r[p - 1] for r, p in zip(ranks, self.prefix, strict=True)])

    def dense(self, a: int, b: int, prefix: bool = False) -> np.ndarray:
        """Which classes hold the ranks a..b-1 (``prefix``: in their prefix)."""
        out = np.zeros((len(self.ranks), b - a), np.float32)
        for i, r in enumerate(self.ranks):
            r = r[: self.prefix[i]] if prefix else r
            out[i, r[np.searchsorted(r, a) : np.searchsorted(r, b)] - a] = 1
        return out

    def segments(self, cuts: np.ndarray, suffix: bool) -> np.ndarray:
        return np.stack([np.diff(np.searchsorted(r[p:] if suffix else r, cuts)) for r, p in zip(self.ranks, self.prefix, strict=True)])


def _verified(a: _Side, b: _Side, same: bool, turn: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of two blocks, by place. turn: of each rank -1 if its pivot comes before this bucket's, 0 if it is that, else 1."""
    common, here = np.zeros((2, len(a.n), len(b.n)), np.float32)
    size, top = len(turn), int(max(a.last.max(), b.last.max())) + 1
    for i in range(0, top, 4096):
        x, y, t = a.dense(i, min(top, i + 4096), True), b.dense(i, min(top, i + 4096), True), turn[i : min(top, i + 4096)]
        common += x @ y.T
        # a pair that has met before loses more than it can gain
        here += (x[:, t <= 0] * np.where(t[t <= 0] < 0, np.float32(-size - 1), np.float32(1))) @ y[:, t <= 0].T
    i, j = np.nonzero(np.triu(here, 1) > 0 if same else here > 0)
    na, nb = a.n[i], b.n[j]
    ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)  # length
    i, j, na, nb = i[ok], j[ok], na[ok], nb[ok]
    need = -(-percent * (na + nb) // (100 + percent))
    c = common[i, j].astype(np.int64)
    first = a.last[i] <= b.last[j]  # whose prefix ends first: what they share up to there is counted in c
    rest_a, rest_b = np.array([len(r) for r in a.ranks]) - a.prefix, np.array([len(r) for r in b.ranks]) - b.prefix
    ok = c + np.where(first, rest_a[i], rest_b[j]) >= need  # positional
    i, j, c, need, first = i[ok], j[ok], c[ok], need[ok], first[ok]
    cuts = np.linspace(0, size, 17).astype(np.int64)
    sa, sb, ta, tb = a.segments(cuts, True), b.segments(cuts, True), a.segments(cuts, False), b.segments(cuts, False)
    bound = c.copy()
    for k in range(16):  # suffix: no more in common than the smaller part between two pivots
        bound += np.where(first, np.minimum(sa[i, k], tb[j, k]), np.minimum(ta[i, k], sb[j, k]))
    ok = bound >= need
    i, j, need = i[ok], j[ok], need[ok]
    if len(i) * 20 < len(a.n) * len(b.n):
        both = np.array([len(np.intersect1d(a.ranks[x], b.ranks[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    else:
        total = np.zeros((len(a.n), len(b.n)), np.float32)
        for k in range(0, size, 4096):
            total += a.dense(k, min(size, k + 4096)) @ b.dense(k, min(size, k + 4096)).T
        both = total[i, j].astype(np.int64)
    ok = both >= need
    return i[ok], j[ok]


def _roots(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place of each place's component, for the links i to j."""
    root = np.arange(size)
    while len(i):
        # roots are hooked, never the places themselves: a tree moves as a whole
        np.minimum.at(root, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        live = root[i] != root[j]
        i, j = i[live], j[live]
    return root


def _block(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, lc, lb, hc, hb = (x.as_py() for x in key)
        same = (lc, lb) == (hc, hb)  # one block, not two of which one is empty
        n, side = table["n"].to_numpy(), table["side"].to_numpy()
        ids, copies = table["set_id"].to_numpy(), table["copies"].to_numpy()
        lists = table["shingles"].combine_chunks()
        flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(lists).to_numpy()
        df = table["dfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        _, at, inverse = np.unique(flat, return_index=True, return_inverse=True)
        rank = np.empty(len(at), np.int64)
        rank[np.lexsort((flat[at], df[at]))] = np.arange(len(at))
        ranks = np.split(rank[inverse], np.cumsum(lengths)[:-1])
        given = table["pivots"].combine_chunks()
        prefixes = pa.compute.list_value_length(given).to_numpy()
        pivots = given.flatten()
        # the place of each prefix shingle among all
        place = np.arange(len(pivots)) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(prefixes) - prefixes), prefixes)
        named = pivots.is_valid().to_numpy(zero_copy_only=False)
        pivot, of = pivots.fill_null(0).to_numpy(zero_copy_only=False)[named], rank[inverse][place[named]]
        turn = np.ones(len(at), np.int8)
        turn[of] = (pivot > bucket).astype(np.int8) - (pivot < bucket)

        def part(k: int) -> tuple[np.ndarray, _Side]:
            where = np.flatnonzero(side == k)
            return where, _Side({"n": n[where], "set_id": ids[where], "copies": copies[where]}, [ranks[x] for x in where], percent)

        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        wa, a = part(0)
        wb, b = (wa, a) if same else part(1)
        if len(wa) and len(wb):
            i, j = _verified(a, b, same, turn, percent)
            i, j = wa[i], wb[j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = _roots(len(ids), i, j)
        keep = links > 0
        return pa.table({"set_id": pa.array(ids[keep]), "root": pa.array(ids[root][keep]), "links": pa.array(links[keep])})

    return run


def jaccard_join(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 64) -> DataFrame:
    """Links documents whose sets of ``n``-word shingles have a Jaccard similarity of ``percent``/100 or more.

    Words are split at ASCII white space and lower-cased in ASCII; a text of fewer words is one
    shingle. Returns one row per input row: the id, n_shingles, component_id (the least id that
    links reach), class_id (rows with equal sets share it) and n_links (other rows that it links
    with directly). Null, empty and blank texts have no shingles, link with nothing and are their
    own component. Repeated rows link with each other; a null id never is a component's id unless
    the component has no other; other columns are ignored, an empty table gives an empty one.
    """
    if not 0 < percent <= 100 or n < 1:
        raise ValueError("n must be at least 1 and percent within 1..100")
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    slim = written(base.mapInArrow(_sets(n, digest_bits), f"_id {id_type}, n bigint, set_id bigint, check bigint"), "sets")
    classes = slim.where("n > 0").groupBy("set_id", "check").agg(F.min("_id").alias("least_id"), F.count("*").alias("copies"), F.max("n").alias("n"))
    classes = written(classes, "classes")
    # of 64-bit digests some three among 10**10 sets; the second digest joins theirs
    again = [r[0] for r in classes.groupBy("set_id").agg(F.count("*").alias("c")).where("c > 1").limit(1_000_001).collect()]
    if len(again) > 1_000_000:
        raise ValueError("too many clashes: take more digest_bits")
    clashes = np.array(again, np.int64).view(np.uint64)
    if again:
        apart = F.pandas_udf(_apart, "bigint")
        table = F.broadcast(spark.createDataFrame([(x,) for x in again], "_clash bigint"))
        slim, classes = (t.join(table, t.set_id == table._clash, "left").withColumn("set_id", F.when(F.col("_clash").isNotNull(), apart("set_id", "check")).otherwise(F.col("set_id"))).drop("_clash") for t in (slim, classes))

    total = slim.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(partitions(spark), -(-total // RANGE))
    counted = base.select("_text").mapInArrow(_counts(n, ranges, digest_bits, clashes), BLOCKS)
    frequencies = written(counted.repartitionById(ranges, F.col("part")).mapInArrow(_summed, BLOCKS), "frequencies")
    packed = base.select("_text").mapInArrow(_ranges(n, ranges, digest_bits, clashes), BLOCKS).unionByName(frequencies)
    often = packed.repartitionById(ranges, F.col("part")).sortWithinPartitions("kind").mapInArrow(_looked_up, "set_id bigint, shingle bigint, df bigint")
    least = F.floor((F.col("n") * percent + 99) / 100).cast("int")
    # a class may come from several runs
    sets = often.groupBy("set_id").agg(F.sort_array(F.collect_set(F.struct("df", "shingle"))).alias("s")).join(classes.select("set_id", "n", "copies"), "set_id")
    sets = written(sets.where(F.size("s") >= least).select("set_id", "n", "copies", F.col("s.shingle").alias("shingles"), F.col("s.df").alias("dfs")), "candidates")
    dropped(frequencies)

    postings = sets.select("set_id", F.posexplode(F.slice("shingles", 1, F.size("shingles") - least + 1)).alias("place", "shingle"))
    pivots = postings.groupBy("shingle").agg(F.min("set_id").alias("pivot"), F.count("*").alias("c")).where("c > 1").select("shingle", "pivot")
    named = postings.join(pivots, "shingle", "left").groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("place", "pivot"))).alias("p"))
    meeting = sets.join(named.select("set_id", F.col("p.pivot").alias("pivots")), "set_id").where(F.exists("pivots", lambda p: p.isNotNull()))
    meeting = written(meeting, "prefixes")
    dropped(sets)
    buckets = meeting.select("set_id", "n", F.size("shingles").alias("m"), F.explode(F.array_distinct(F.array_compact("pivots"))).alias("bucket"))

    wide = 1.0000001 * np.log(100 / percent) if percent < 100 else 1e-9
    member = buckets.withColumn("cls", F.floor(F.log("n") / float(wide)))
    counts = member.groupBy("bucket", "cls").agg(F.count("*").alias("c"), F.sum("m").alias("t")).select("bucket", "cls", "c", F.ceil(F.greatest(F.col("c") / BLOCK_MEMBERS, F.col("t") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    counts = written(counts, "blocks")
    up = counts.select("bucket", (F.col("cls") - 1).alias("cls"), F.col("nb").alias("up"))
    down = counts.select("bucket", (F.col("cls") + 1).alias("cls"), F.col("nb").alias("down"))
    plan = counts.join(up, ["bucket", "cls"], "left").join(down, ["bucket", "cls"], "left")
    member = member.join(plan, ["bucket", "cls"]).withColumn("b", F.pmod(F.xxhash64("set_id"), F.col("nb")).cast("int"))
    zero, cls, b = F.lit(0), F.col("cls"), F.col("b")

    def keys(count, make):
        return F.when(count > 0, F.transform(F.sequence(zero, count - 1), make)).otherwise(F.array().cast("array<struct<lc:bigint,lb:int,hc:bigint,hb:int,side:int>>"))

    def key(lc, lb, hc, hb, side):
        return F.struct(lc.alias("lc"), lb.alias("lb"), hc.alias("hc"), hb.alias("hb"), side.cast("int").alias("side"))

    dealt = member.select(
        "set_id", "bucket",
        F.explode(F.concat(
            keys(F.when(F.col("c") > 1, F.col("nb")).otherwise(0), lambda j: key(cls, F.least(b, j), cls, F.greatest(b, j), b > j)),
            keys(F.coalesce("up", zero), lambda j: key(cls, b, cls + 1, j, F.lit(0))),
            keys(F.coalesce("down", zero), lambda j: key(cls - 1, j, cls, b, F.lit(1))),
        )).alias("k"),
    ).select("set_id", "bucket", "k.*")
    links = written(dealt.join(meeting, "set_id").groupBy("bucket", "lc", "lb", "hc", "hb").applyInArrow(_block(percent), "set_id bigint, root bigint, links bigint"), "links")
    found = components(links.select(F.col("set_id").alias("u"), F.col("root").alias("v")))
    roots = found.join(classes.select(F.col("set_id").alias("node"), "least_id"), "node")
    named = roots.join(roots.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select(F.col("node").alias("set_id"), "component_id")
    labels = classes.join(named, "set_id", "left").join(links.groupBy("set_id").agg(F.sum("links").alias("links")), "set_id", "left")
    labels = labels.select("set_id", F.coalesce("component_id", "least_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = slim.where("n > 0").join(labels, "set_id").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("set_id").alias("class_id"), "n_links")
    return out.unionByName(slim.where("n = 0").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("_id").alias("component_id"), F.lit(None).cast("bigint").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")))

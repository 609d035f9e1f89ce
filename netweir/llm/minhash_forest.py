"""MinHash near-duplicates with an LSH forest.

Every distinct shingle set gets ``TREES`` paths of ``DEPTH`` minima. Each tree is one sorted
order of the paths; runs that agree on at least ``ROOT`` minima are candidates. A run that is
still crowded is cut one minimum deeper, again and again, so depth follows the density of each
region, and neighbours in the order with the longest common prefix stay candidates. Runs that
stay crowded at full depth and whose texts do not end in one component are compared in full
afterwards, in pairs of blocks. All links are confirmed on full shingle sets. Nothing but what
joins components leaves a comparison: at most one link per text and block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweir.llm.common import components, discard, in_batches, partitions, random_words, shingles, small_batches, stored
from netweir.operators.joins import fits_broadcast

TREES, DEPTH, ROOT = 24, 6, 4
CROWD = 12  # a run of at most so many texts is compared in full within its tree
CHUNK, CHUNK_SHINGLES = 256, 1_000_000  # texts whose sets one group compares
BLOCK = 512  # texts of a crowded run that meet another such block
COLUMNS = 2048  # shingles that are counted at once when texts of a group are compared
RUN = 2  # marks the count of a run among a partition's rows
WIDTH = 2 * DEPTH  # bytes of a path: 16 bits of each minimum
PLAUSIBLE = 5.0  # standard errors below the limit at which an estimate rules a pair out
ODD = random_words(TREES * DEPTH, 9) | np.uint64(1)


def minima(sets: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima (32 bits each) of a set of hashes."""
    best = np.full(len(ODD), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sets), 4096):
        part = sets[at : at + 4096, None] * ODD[None, :]
        np.minimum(best, (part >> np.uint64(32)).min(axis=0).astype(np.uint32), out=best)
    return best


def set_name(sets: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of hashes."""
    if not len(sets):
        return 0, 0
    return int(sets.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(sets * (sets >> np.uint64(7) | np.uint64(1))).view(np.int64))


SKETCH = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("paths", pa.binary()), ("mini", pa.binary())])


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, a hash of the text, size of the shingle set, its 128-bit name (k1, k2), its paths
    in all trees, one after the other, and one byte of every minimum for estimates."""

    def make(ids, hashes, texts):
        n, k1, k2, paths, mini = [], [], [], [], []
        for text in texts:
            s = shingles(text, words)
            name = set_name(s)
            n.append(len(s))
            k1.append(name[0])
            k2.append(name[1])
            m = minima(s) if len(s) else None
            # The low bits of a minimum are evenly spread, its high bits are not.
            paths.append(None if m is None else (m & np.uint32(0xFFFF)).astype(">u2").tobytes())
            mini.append(None if m is None else ((m >> np.uint32(4)) & np.uint32(0xFF)).astype(np.uint8).tobytes())
        return ids, hashes, n, k1, k2, paths, mini

    plain = _plain(docs).select("doc_id", text_hash("text").alias("text_hash"), "text")
    return plain.mapInArrow(in_batches(["doc_id", "text_hash", "text"], make, SKETCH), "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, paths binary, mini binary")


def text_hash(column: str) -> Column:
    """Tells texts under one doc_id apart; null and empty texts are one."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _crowds(keys: list[bytes], lo: int, hi: int, depth: int, out: list[tuple[int, int]]) -> None:
    """Pairs of positions among keys[lo:hi], sorted, that agree on ``depth`` minima."""
    work = [(lo, hi, depth)]
    while work:
        lo, hi, depth = work.pop()
        if hi - lo < 2:
            continue
        if hi - lo <= CROWD:
            out.extend((i, j) for i in range(lo, hi) for j in range(i + 1, hi))
            continue
        out.extend((i, i + 1) for i in range(lo, hi - 1))  # longest common prefixes
        if depth < DEPTH:
            start = lo
            for i in range(lo + 1, hi + 1):
                if i == hi or keys[i][: 2 * (depth + 1)] != keys[start][: 2 * (depth + 1)]:
                    work.append((start, i, depth + 1))
                    start = i


def _pairs_of(trees, keys, ids) -> tuple[list[int], list[int]]:
    found: list[tuple[int, int]] = []
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or trees[i] != trees[start] or keys[i][: 2 * ROOT] != keys[start][: 2 * ROOT]:
            _crowds(keys, start, i, ROOT, found)
            start = i
    a = [min(ids[i], ids[j]) for i, j in found]
    b = [max(ids[i], ids[j]) for i, j in found]
    return a, b


def _neighbours(batches):
    """Candidate pairs within a sorted partition, its first and last rows for the seams, and how
    many texts share a full path, where they are a crowd or may go on in another partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("seam", pa.int32()), ("side", pa.int32()), ("tree", pa.int32()), ("path", pa.binary())])

    def rows(a, b, seam, side, tree, path):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((a, b, seam, side, tree, path), schema)], schema=schema)

    def ended(runs):
        n = len(runs)
        return rows([r[2] for r in runs], [None] * n, [None] * n, [RUN] * n, [r[0] for r in runs], [r[1] for r in runs])

    held: tuple[list, list, list] = ([], [], [])
    first = None
    run, outer = None, True  # the run at hand (tree, path, texts); whether it is the partition's first
    for batch in batches:
        if not batch.num_rows:
            continue
        t, k, i = (batch.column(c).to_pylist() for c in ("tree", "path", "id"))
        over = []
        for tree, path in zip(t, k):
            if run and run[1] == path and run[0] == tree:
                run[2] += 1
                continue
            if run:
                over += [run] if outer or run[2] > CROWD else []
                outer = False
            run = [tree, path, 1]
        yield ended(over)
        t, k, i = held[0] + t, held[1] + k, held[2] + i
        if first is None:
            first = (t[:CROWD], k[:CROWD], i[:CROWD])
        # The last run may go on in the next batch; a crowded one hands over its end only.
        cut = len(k)
        while cut and t[cut - 1] == t[-1] and k[cut - 1][: 2 * ROOT] == k[-1][: 2 * ROOT]:
            cut -= 1
        if len(k) - cut > 4096:
            cut = len(k) - CROWD
            a, b = _pairs_of(t, k, i)
        else:
            a, b = _pairs_of(t[:cut], k[:cut], i[:cut])
        held = (t[cut:], k[cut:], i[cut:])
        n = len(a)
        yield rows(a, b, [None] * n, [None] * n, [None] * n, [None] * n)
    if first is not None:
        yield ended([run])
        a, b = _pairs_of(*held)
        n = len(a)
        yield rows(a, b, [None] * n, [None] * n, [None] * n, [None] * n)
        last = tuple(x[-CROWD:] for x in held)
        for (t, k, i), seam, side in ((first, part - 1, 1), (last, part, 0)):
            n = len(i)
            yield rows(i, [None] * n, [seam] * n, [side] * n, t, k)


def _seam(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs across one border between two partitions."""
    pdf = pdf.sort_values(["tree", "path", "a"])
    a, b = _pairs_of(pdf["tree"].tolist(), pdf["path"].tolist(), pdf["a"].tolist())
    return pd.DataFrame({"a": a, "b": b}, dtype="int64")


def forest_pairs(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a, b) of (id, tree, path), and the runs (tree, path, n) that are
    crowded at full depth."""
    spark = paths.sparkSession
    ordered = paths.repartitionByRange(max(partitions(spark), 2), "tree", "path", "id").sortWithinPartitions("tree", "path", "id")
    found = stored(ordered.mapInArrow(_neighbours, "a long, b long, seam int, side int, tree int, path binary"), "forest")
    seams = found.filter("seam is not null").groupBy("seam").applyInPandas(_seam, "a long, b long")
    runs = found.filter(F.col("side") == RUN).groupBy("tree", "path").agg(F.sum("a").alias("n")).filter(F.col("n") > CROWD)
    return found.filter("seam is null and side is null").select("a", "b").unionAll(seams).filter("a <> b").distinct(), runs


def _least_equal(limit: float) -> float:
    """The number of equal bytes below which the sketches of a pair at ``limit`` practically
    never lie. Unequal minima share their byte once in 256 times."""
    n, p = TREES * DEPTH, limit + (1 - limit) / 256
    return n * (p - PLAUSIBLE * (p * (1 - p) / n) ** 0.5)


def plausible(pairs: DataFrame, sketches: DataFrame, limit: float) -> DataFrame:
    """Pairs whose sketches agree well enough to be worth a full comparison."""
    least = _least_equal(limit)

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                ok = (_matrix(batch.column("ma")) == _matrix(batch.column("mb"))).sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    joined = (
        pairs.join(sketches.select(F.col("id").alias("a"), F.col("mini").alias("ma"), F.col("n_shingles").alias("na")), "a")
        .join(sketches.select(F.col("id").alias("b"), F.col("mini").alias("mb"), F.col("n_shingles").alias("nb")), "b")
        .filter(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(limit) - 0.001)
    )
    return joined.select("a", "b", "ma", "mb").mapInArrow(keep, "a long, b long")


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), TREES * DEPTH)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets (sorted, distinct) overlap by ``percent`` of their union, as a matrix.

    Overlaps are counted by matrix products over the hashes that at least two sets hold.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.append(True, values[1:] != values[:-1])[: len(values)]
    number = np.cumsum(first) - 1
    shared = np.bincount(number)[number] > 1 if len(number) else np.empty(0, bool)
    column, owner = np.cumsum(first[shared]) - 1, owner[shared]
    both = np.zeros((n, n), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        x = np.zeros((n, COLUMNS), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    np.fill_diagonal(both, sizes)
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def forest(link: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places that join all that ``link`` joins beyond groups that are ``known``: a
    star around the first member of each group that results, one ray for each known group."""
    out, left = [], np.ones(len(link), bool)
    for root in range(len(link)):
        if not left[root]:
            continue
        left[root], work, rays = False, [root], {}
        while work:
            i = work.pop()
            rays.setdefault(int(known[i]), i)
            met = np.flatnonzero(left & (link[i] | (known == known[i])))
            left[met] = False
            work += met.tolist()
        out += [(root, i) for group, i in rays.items() if group != int(known[root])]
    return out


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, shingle set) of the documents of ``wanted`` (doc_id, id, k1, k2).

    A doc_id may have rows with other texts; the set's name tells them apart.
    """
    known = F.broadcast(wanted) if fits_broadcast(wanted) else wanted

    def make(ids, texts, k1, k2):
        sets = [shingles(t, words) for t in texts]
        ok = [set_name(s) == name for s, name in zip(sets, zip(k1, k2))]
        return [i if x else None for i, x in zip(ids, ok)], [s.tobytes() if x else None for s, x in zip(sets, ok)]

    schema = pa.schema([("id", pa.int64()), ("hashes", pa.binary())])
    both = _plain(docs).join(known, "doc_id").select("id", "text", "k1", "k2")
    return both.mapInArrow(in_batches(["id", "text", "k1", "k2"], make, schema), "id long, hashes binary").filter("id is not null")


def _joined_within(percent: int):
    """For the texts of a group: links that join them, each confirmed on full sets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id")
        ids = pdf["id"].to_numpy()
        known = pdf["known"].to_numpy() if "known" in pdf else ids
        link = linked([np.frombuffer(x, np.uint64) for x in pdf["hashes"]], percent)
        pairs = forest(link, np.unique(known, return_inverse=True)[1])
        return pd.DataFrame({"a": [ids[i] for i, _ in pairs], "b": [ids[j] for _, j in pairs]}, dtype="int64")

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def make(a, b, x, y):
        x, y = ([np.frombuffer(v, np.uint64) for v in s] for s in (x, y))
        both = [len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y)]
        return a, b, [100 * n >= percent * (len(s) + len(t) - n) for s, t, n in zip(x, y, both)]

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ok", pa.bool_())])
    # Only the sets of these pairs are shuffled to them.
    ids = stored(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
    wanted = sets.join(F.broadcast(ids) if fits_broadcast(ids) else ids, "id", "left_semi").dropDuplicates(["id"])
    of = lambda end, name: wanted.select(F.col("id").alias(end), F.col("hashes").alias(name))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(in_batches(["a", "b", "x", "y"], make, schema), "a long, b long, ok boolean")


def _with_components(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components, with these (ca, cb)."""
    c = comps.select("id", "component")
    return (
        pairs.join(c.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(c.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
        .select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
        .filter("ca <> cb")
    )


def _open_runs(paths: DataFrame, crowds: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of ``crowds``, the runs that are crowded at full depth, as far as these hold more than one component, with the
    pairs of blocks (i, j) of their run that they take part in.

    Members of the run's largest component need no comparison with each other, so they have
    blocks of their own, which meet the blocks of the others only.
    """
    inside = paths.join(F.broadcast(crowds) if fits_broadcast(crowds) else crowds, ["tree", "path"], "left_semi")
    rows = inside.join(comps.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = rows.groupBy("tree", "path", "component").agg(F.count("*").alias("n"))
    runs = parts.groupBy("tree", "path").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("most"))
    crowded = runs.filter((F.col("n") > CROWD) & (F.col("parts") > 1)).select(
        "tree", "path", F.col("most.component").alias("most"),
        F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("others"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("mosts"),
    )
    members = rows.join(crowded, ["tree", "path"]).withColumn("inner", F.col("component") == F.col("most"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("inner"), F.col("mosts")).otherwise(F.col("others"))).cast("int")
    members = members.withColumn("block", block)
    met = F.when(F.col("inner"), F.expr("transform(sequence(0, others - 1), k -> struct(k as i, others + block as j))")).otherwise(
        F.expr(
            "concat(transform(sequence(0, others - 1), k -> struct(least(k, block) as i, greatest(k, block) as j)),"
            " transform(sequence(0, mosts - 1), k -> struct(block as i, others + k as j)))"
        )
    )
    return members.withColumn("pair", F.explode(met)).select("tree", "path", "pair.i", "pair.j", "id", "component")


def _plausible_members(limit: float):
    """Texts of a pair of blocks with a plausible partner in another component that they meet
    in no earlier tree."""
    least = _least_equal(limit)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id")
        m, component, size = _matrix(pdf["mini"]), pdf["component"].to_numpy(), pdf["n_shingles"].to_numpy()
        paths = np.frombuffer(b"".join(pdf["paths"]), np.dtype((np.void, WIDTH))).reshape(len(pdf), TREES)[:, : int(pdf["tree"].iloc[0])]
        wanted = np.zeros(len(pdf), bool)
        for i in range(len(pdf) - 1):
            ok = (component[i + 1 :] != component[i]) & (np.minimum(size[i + 1 :], size[i]) >= np.maximum(size[i + 1 :], size[i]) * limit - 0.001)
            at = np.flatnonzero(ok) + i + 1
            at = at[(m[at] == m[i]).sum(axis=1) >= least]
            at = at[~(paths[at] == paths[i]).any(axis=1)]
            wanted[at] = True
            wanted[i] |= len(at) > 0
        return pdf.loc[wanted, ["tree", "path", "i", "j", "id", "component"]]

    return run


def _open_links(paths: DataFrame, crowds: DataFrame, comps: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components within crowded runs."""
    full = _open_runs(paths, crowds, comps).join(reps.select("id", "n_shingles", "paths", "mini"), "id")
    ddl = "tree int, path binary, i int, j int, id long, component long"
    wanted = stored(full.groupBy("tree", "path", "i", "j").applyInPandas(_plausible_members(percent / 100), ddl), "plausible")
    names = reps.join(wanted.select("id").distinct(), "id", "left_semi").select("doc_id", "id", "k1", "k2")
    sets = stored(full_sets(docs, stored(names, "names"), words), "sets")
    met = wanted.withColumnRenamed("component", "known").join(sets, "id")
    return met.groupBy("tree", "path", "i", "j").applyInPandas(_joined_within(percent), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents whose shingle sets overlap by ``percent`` of their union or more.

    docs: doc_id, text and any other columns. Returns a row per row of docs: doc_id,
    n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id is
    component_id). Null and empty texts have an empty set and link with nothing; texts with
    fewer words than a shingle have their whole word sequence as one; equal sets always link;
    a repeated row gets a row each time; rows that share a doc_id but not a text are documents of
    their own, each in the group of its text; a null doc_id links with nothing, its component is
    null and it is kept. An empty table gives no rows.
    """
    return groups(docs, words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``near_duplicates`` with text_hash, which tells texts under one doc_id apart,
    and group_id, which rows have in common if links join them (null: without words or doc_id)."""
    small_batches(docs.sparkSession)
    classes, comps = _classes(docs, words, percent)
    found = classes.join(comps.select("id", "component"), "id", "left").withColumn("group_id", F.coalesce("component", "id"))
    least = found.filter("group_id is not null").groupBy("group_id").agg(F.min("doc_id").alias("component_id"))
    named = found.join(F.broadcast(least) if fits_broadcast(least) else least, "group_id", "left")
    # Texts without words stand for themselves.
    out = named.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    return out.select("doc_id", "text_hash", "n_shingles", "group_id", "component_id", kept)


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """A row per row of docs (doc_id, text_hash, n_shingles, id of its set or null) and the
    components (id, component) of sets that link with others."""
    sk = stored(sketch(docs, words), "sketch")
    named = sk.filter("n_shingles > 0 and doc_id is not null")
    reps = named.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("paths").alias("paths"), F.first("mini").alias("mini"))
    reps = stored(reps.withColumn("id", F.monotonically_increasing_id()), "reps")
    of_set = reps.select("n_shingles", "k1", "k2", "id")
    rows = sk.select("doc_id", "text_hash", "n_shingles", "k1", "k2").join(of_set, ["n_shingles", "k1", "k2"], "left")
    rows = stored(rows.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("id")).alias("id")), "members")
    discard(sk)
    cut = F.expr(f"transform(sequence(0, {TREES - 1}), i -> substring(paths, i * {WIDTH} + 1, {WIDTH}))")
    paths = reps.select("id", F.posexplode(cut).alias("tree", "path"))
    near, runs = forest_pairs(paths)
    crowds = stored(runs, "crowds")
    pairs = stored(plausible(near, reps, percent / 100), "pairs")

    # Tentative groups decide only which texts travel together; links are confirmed below.
    sized = components(pairs).join(reps.select("id", "doc_id", "n_shingles", "k1", "k2"), "id")
    size = sized.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks")
    )
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk")
    chunked = stored(sized.join(size, "component").select("id", "doc_id", "k1", "k2", "component", chunk), "chunks")
    sets = stored(full_sets(docs, chunked.select("doc_id", "id", "k1", "k2"), words), "sets")
    place = chunked.select("id", "component", "chunk")
    travel = sets.join(F.broadcast(place) if fits_broadcast(place) else place, "id")
    links = stored(travel.groupBy("component", "chunk").applyInPandas(_joined_within(percent), "a long, b long"), "links")
    comps = _settle(components(links), _across_chunks(pairs, place), sets, percent)
    more = stored(_open_links(paths, crowds, comps, reps, docs, words, percent), "links")
    return rows, _merged(comps, more)


def _across_chunks(pairs: DataFrame, chunked: DataFrame) -> DataFrame:
    """Pairs whose ends did not travel in one chunk, where all pairs were compared."""
    of = lambda end: chunked.select(F.col("id").alias(end), F.struct("component", "chunk").alias(f"chunk_{end}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(~F.coalesce(F.col("chunk_a") == F.col("chunk_b"), F.lit(False))).select("a", "b")


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links between their members: only their own ids are joined anew."""
    met = components(_with_components(links, comps).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    moved = comps.join(met.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left")
    return stored(moved.select("id", F.coalesce("now", "component").alias("component")).unionAll(met).distinct(), "components")


def _settle(comps: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirm the candidates that still cross components, some per pair of components a round.

    The number tried per pair of components grows, so the rounds are few, and a pair whose ends
    have met in one component needs no comparison.
    """
    tries, per = pairs, 1
    while True:
        tries = stored(_with_components(tries.select("a", "b"), comps), "crossing")
        if tries.isEmpty():
            return comps
        key = [F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"), F.pmod(F.xxhash64("a", "b"), F.lit(per)).alias("z")]
        chosen = stored(tries.groupBy(*key).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"), "chosen")
        tested = stored(_confirm(chosen, sets, percent), "tested")
        tries = tries.select("a", "b").join(tested.select("a", "b"), ["a", "b"], "left_anti")
        comps = _merged(comps, tested.filter("ok").select("a", "b"))
        per *= 16

"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import map_batches
from .components import checkpoint, join_hot

TABLES = 4
#: Cross-polytopes that a table concatenates: as many as the rows ask for, and at most this many.
POLYTOPES = 4
#: Rows, and queries, that one task compares at a time.
CHUNK = 8192
#: Probes are set so that this share of the true neighbours of at most SAMPLE queries is found.
RECALL, SAMPLE = 0.97, 64
#: A table with up to this many cells may be probed in all of them, a larger one in MOST_PROBES.
ALL_CELLS, MOST_PROBES = 1 << 14, 1 << 11
#: Copies of a vector are gathered in this many parts first.
SALTS = 12


@functools.cache
def _signs(dim: int) -> np.ndarray:
    return np.random.RandomState(7).choice([-1.0, 1.0], size=(TABLES, POLYTOPES, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two of columns), of unchanged length."""
    n, width = x.shape
    x, h = x.copy(), 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def axes_of(dim: int) -> int:
    """Signed axes of a cross-polytope for vectors of dim components."""
    return 2 << max(1, (dim - 1).bit_length())


def polytopes_for(rows: int, axes: int) -> int:
    """Polytopes to a table: cells about as many as rows, or as may all be probed."""
    return max(2 if axes**2 <= ALL_CELLS else 1, min(POLYTOPES, round(np.log(max(2, rows)) / np.log(axes))))


def rotated(x: np.ndarray, table: int, polytope: int) -> np.ndarray:
    """The components of unit vectors along every signed axis (2 * axis, plus 1 on its negative side) of a
    pseudo-rotation: three rounds of random signs and a Hadamard transform."""
    y = np.zeros((len(x), axes_of(x.shape[1]) // 2))
    y[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    for signs in _signs(y.shape[1])[table, polytope]:
        y = hadamard(y * signs)
    return np.stack([y, -y], axis=2).reshape(len(y), -1)


def nearest_axes(x: np.ndarray, polytopes: int) -> np.ndarray:
    """The nearest signed axis in each table and polytope: rows x TABLES x polytopes."""
    return np.stack([np.stack([rotated(x, t, p).argmax(1) for p in range(polytopes)], 1) for t in range(TABLES)], 1)


def cell_numbers(axes: np.ndarray, n: int) -> np.ndarray:
    """The cells of concatenated axes (last dimension), n axes to a polytope."""
    out = axes[..., 0].astype(np.int64)
    for p in range(1, axes.shape[-1]):
        out = out * n + axes[..., p]
    return out


def probed_cells(along: list[np.ndarray], probes: int) -> tuple[np.ndarray, float]:
    """The cells of one table whose joint score for a query is among the `probes` greatest, and the least such
    score. The joint score is the sum of the query's components along the cell's axes. A cell among the first
    has its shorter cell among the first of the shorter table, so each polytope extends only those."""
    cells, score = np.zeros(1, dtype=np.int64), np.zeros(1)
    for y in along:
        cells, score = (cells[:, None] * len(y) + np.arange(len(y))).ravel(), (score[:, None] + y).ravel()
        if len(score) > probes:
            least = np.partition(score, len(score) - probes)[len(score) - probes]
            cells, score = cells[score >= least], score[score >= least]
    return cells, float(score.min())


def _vectors(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part: not null, not zero, all finite."""
    v = F.col(column).cast("array<double>")
    ok = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector")).filter("vec_id is not null")
    return rows.filter(ok & F.exists("vector", lambda x: x != 0))


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """vector and its `keep` smallest vec_ids, one row for each distinct vector: copies of a vector have
    equal scores, so more of them can never be among the nearest. Hot vectors are cut down in parts."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    some = rows.withColumn("part", part).withColumn("n", F.row_number().over(Window.partitionBy("vector", "part").orderBy("vec_id"))).filter(F.col("n") <= keep)
    least = some.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("n") <= keep)
    ids = least.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return ids.select(F.element_at("ids", 1).alias("cls"), "vector", "ids")


def _matrix(column) -> np.ndarray:
    return np.array(column, dtype=np.float64)


def _calibrated(classes: DataFrame, queries: DataFrame, k: int, dim: int, most: int) -> tuple[int, int, float]:
    """Polytopes and probes a table, and the recall then: the most polytopes, and with them the fewest probes,
    that find RECALL of the exact neighbours of at most SAMPLE queries. These are compared with all rows in one
    pass, in which the sampled vectors travel with the tasks."""
    sample = queries.orderBy(F.xxhash64("cls")).limit(SAMPLE).collect()
    if not sample:
        return 1, 1, 1.0
    q, own, n = _matrix([r["vector"] for r in sample]), np.array([r["cls"] for r in sample]), axes_of(dim)

    def best(cls, vectors):
        x = _matrix(vectors)
        score = np.where(np.array(cls)[None, :] == own[:, None], -np.inf, q @ x.T)
        top = np.argsort(-score, axis=1)[:, :k]
        axes = nearest_axes(x, most).reshape(len(x), -1)
        return np.repeat(np.arange(len(q)), top.shape[1]).tolist(), np.take_along_axis(score, top, 1).ravel().tolist(), axes[top.ravel()].tolist()

    near = map_batches(classes.select("cls", "vector"), best, "q int, score double, axes array<int>").filter("score > double('-Infinity')")
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("n") <= k)
    found = ranked.select("q", "axes").collect()  # SAMPLE * k rows at most
    if not found:
        return 1, 1, 1.0
    of, axes = np.array([r["q"] for r in found]), np.array([r["axes"] for r in found]).reshape(len(found), TABLES, most)
    along = [[rotated(q, t, p) for p in range(most)] for t in range(TABLES)]
    for polytopes in range(most, 0, -1):
        cells = n**polytopes
        limit = cells if cells <= ALL_CELLS or polytopes == 1 else MOST_PROBES
        place = np.full(len(found), limit)
        for t in range(TABLES):
            for i in np.unique(of):
                some, _ = probed_cells([along[t][p][i] for p in range(polytopes)], limit)
                joint = np.sort(sum(along[t][p][i][some // n ** (polytopes - 1 - p) % n] for p in range(polytopes)))
                here = of == i
                score = sum(along[t][p][i][axes[here, t, p]] for p in range(polytopes))
                place[here] = np.minimum(place[here], len(joint) - np.searchsorted(joint, score, side="right"))
        place.sort()
        probes = int(place[min(len(place) - 1, int(RECALL * len(place)))]) + 1
        if probes <= limit:
            return polytopes, probes, float((place < probes).mean())
    raise AssertionError("a table of one polytope can be probed whole")


def _search(k: int, polytopes: int):
    def search(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        """The k nearest candidates of each query among the rows of one block of one table. A candidate is a row
        whose cell the query probes in this table and in none before, so no pair is multiplied twice."""
        empty = pa.table({"q": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "tried": pa.array([], pa.int64())})
        if not queries.num_rows or not rows.num_rows:
            return empty
        q, x = _matrix(queries["vector"].to_pylist()), _matrix(rows["vector"].to_pylist())
        bound = queries["bound"].to_numpy()
        q_ids, ids, least, table = queries["q"].to_numpy(), rows["cls"].to_numpy(), _matrix(queries["least"].to_pylist()), rows["tab"][0].as_py()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        axes = nearest_axes(x, polytopes)
        out = []
        for at in range(0, len(q), 256):
            part, open_ = q[at : at + 256], None
            for t in range(table, -1, -1):
                joint = sum(rotated(part, t, p)[:, axes[:, t, p]] for p in range(polytopes))
                probed = joint >= least[at : at + 256, t, None]
                open_ = probed if open_ is None else open_ & ~probed
            for i, row in enumerate(open_):
                near = np.flatnonzero(row)
                if not len(near):
                    continue
                tried, score = len(near), x[near] @ part[i]
                inside = np.flatnonzero(score >= bound[at + i])
                if len(inside) > k:
                    last = np.partition(score[inside], len(inside) - k)[len(inside) - k]
                    inside = np.r_[inside[score[inside] > last], inside[score[inside] == last]][:k]
                near, score = near[inside], score[inside]
                out.append((np.full(len(near), q_ids[at + i]), ids[near], score, np.full(len(near), tried)))
        if not out:
            return empty
        return pa.table(dict(zip(("q", "cls", "score", "tried"), map(np.concatenate, zip(*out)))))

    return search


def _dealt(side: DataFrame, blocks: DataFrame, own: str, other: str, id_column: str) -> DataFrame:
    """side in blocks of bounded size: a row in its own part, once for each part of the other side."""
    d = join_hot(side, blocks.select("tab", "place", F.col(f"n_{own}").alias("n"), "rows", "queries"), ["tab", "place"], [id_column])
    d = d.withColumn(f"{own}_part", F.pmod(F.xxhash64(id_column), F.col(own)).cast("int"))
    return d.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("rows", "queries")


def candidates(classes: DataFrame, ask: DataFrame, k: int, dim: int, polytopes: int, probes: int) -> DataFrame:
    """q, cls, score, tried: of each query and block the k best of the candidates that were multiplied (tried),
    without those below the bound of the query, if ask has such a column.

    A table's cells lie in order in as many places as the rows fill chunks; a row goes to one place of each
    table, a query, with its vector, once to every place of a table that holds a cell that it probes."""
    n = axes_of(dim)
    cells, places = n**polytopes, max(1, -(-classes.count() // CHUNK))

    def place_of(cell: np.ndarray) -> np.ndarray:
        return (cell / cells * min(places, cells)).astype(np.int64)

    def hashed(cls, vectors):
        place = place_of(cell_numbers(nearest_axes(_matrix(vectors), polytopes), n))
        return [c for c in cls for _ in range(TABLES)], [v for v in vectors for _ in range(TABLES)], list(range(TABLES)) * len(cls), place.ravel().tolist()

    def probing(cls, vectors, bounds):
        x, out = _matrix(vectors), []
        along = [[rotated(x, t, p) for p in range(polytopes)] for t in range(TABLES)]
        for i, c in enumerate(cls):
            found = [probed_cells([y[i] for y in table], probes) for table in along]
            least = [score for _, score in found]
            out += [(c, vectors[i], bounds[i], least, t, p) for t, (some, _) in enumerate(found) for p in np.unique(place_of(some)).tolist()]
        return [list(x) for x in zip(*out)] if out else [[]] * 6

    index = checkpoint(map_batches(classes.select("cls", "vector"), hashed, "cls long, vector array<double>, tab int, place long"))
    bound = F.col("bound") if "bound" in ask.columns else F.lit(float("-inf"))
    ask = ask.select("cls", "vector", bound.alias("bound"))
    asked = checkpoint(map_batches(ask, probing, "q long, vector array<double>, bound double, least array<double>, tab int, place long"))
    count = lambda df, name: df.groupBy("tab", "place").agg(F.count("*").alias(f"n_{name}"), F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    blocks = checkpoint(count(index, "rows").join(count(asked, "queries"), ["tab", "place"]))
    key = ["tab", "place", "rows_part", "queries_part"]
    left, right = _dealt(asked, blocks, "queries", "rows", "q"), _dealt(index, blocks, "rows", "queries", "cls")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search(k, polytopes), "q long, cls long, score double, tried long")


def _searched(classes: DataFrame, ask: DataFrame, k: int, dim: int, polytopes: int, probes: int, n: int) -> DataFrame:
    """q, cls, score, n: the k best candidates of each query, numbered from 1.

    Rows are searched in steps, each of four times as many as before, dealt by hash. Of a step only candidates
    that reach the k-th best so far are passed on, so that a query gives some multiples of k rows in all, however
    many places it looks into. No row is in two steps."""
    steps, best = 0, None
    while n > CHUNK * 4**steps:
        steps += 1
    draw = F.xxhash64("cls", F.lit("step"))
    for step in range(steps, -1, -1):
        own = F.pmod(draw, F.lit(4**step)) == 0
        part = classes.filter(own if step == steps else own & (F.pmod(draw, F.lit(4 ** (step + 1))) != 0))
        if best is not None:
            bounds = best.filter(F.col("n") == k).select(F.col("q").alias("cls"), F.col("score").alias("bound"))
            ask = ask.drop("bound").join(bounds, "cls", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        found = candidates(part, ask, k, dim, polytopes, probes).select("q", "cls", "score")
        found = found if best is None else found.unionByName(best.select("q", "cls", "score"))
        best = checkpoint(found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls"))).filter(F.col("n") <= k))
    return best


def nearest(df: DataFrame, queries, k: int = 20, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows, by inner product in double precision, of each
    row that the condition `queries` (over column vec_id) picks; itself excepted, nearest first, ties to
    the smaller vec_id.

    Equal vectors form one class, with the few smallest ids that can matter. Each class is hashed in TABLES
    tables, whose cells are concatenated cross-polytopes, as many as the number of rows asks for; a query looks
    into the cells of the greatest joint scores. A calibration on a bounded sample of queries sets the number of
    probes, and takes fewer polytopes where these would need too many. Cells are searched in blocks of bounded
    numbers of rows and queries, each giving at most k + 1 rows a query, so that neither a hot cell nor a hot
    vector meets in one task; a pair that meets in several tables is multiplied in the first.

    Vectors that are null, zero, hold null or non-finite components, or are not of the commonest length
    take no part; rows with a null vec_id neither. A repeated vec_id is two rows, neither of which finds
    a row of its own id. With fewer than k candidates all that are found are returned. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = _vectors(df, id_column, column)
    length = rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
    dim = length["length"] if length else 1
    rows = rows.filter(F.size("vector") == dim)
    classes = checkpoint(_classes(rows, k + 1))
    asked = rows.filter(queries).select("vec_id", "vector")
    ask = checkpoint(classes.join(asked.select("vector").distinct(), "vector", "left_semi").select("cls", "vector"))
    n = classes.count()
    polytopes, probes, _ = _calibrated(classes, ask, k, dim, polytopes_for(n, axes_of(dim)))
    top = _searched(classes, ask, k + 1, dim, polytopes, probes, n)
    members = top.join(classes.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias("vec_id"))
    members = members.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    lists = members.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    per_class = classes.join(lists, classes["cls"] == lists["q"]).select("vector", "near")
    own = asked.withColumnRenamed("vec_id", "query_id").join(per_class, "vector")
    rest = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(rest).alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))

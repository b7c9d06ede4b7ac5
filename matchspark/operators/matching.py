"""Vacancy-candidate scoring: one request by expressions, many by matrices.

Scoring many vacancies needs every admitted pair once for the minimum of each
similarity and once for the score, but no pair is ever written as a row: a task
multiplies a batch of candidates with a set of vacancies and returns a minimum, or
the best k, per vacancy. The products are in single precision and only name the
pairs that may count; these are filtered and computed in double precision. A counted, small set of vacancies is sent to the
candidates, which then are not shuffled at all. Larger sets are ordered by place and
packed, like the candidates, into rows of many; each pack is written once, and pairs of
packs that share a block (place or region) are met by reading, not by copying.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from matchspark import vocab
from matchspark.functions import filters, geo, text, vectors
from matchspark.functions.geo import EARTH_RADIUS_KM
from matchspark.functions.once import where_computed
from matchspark.functions.vectors import EPSILON
from matchspark.sources.tables import staged

SIMS = ("last", "second", "third", "skills")
CANDIDATE_VECTORS = ["last_job_emb", "second_last_job_emb", "third_last_job_emb", "skills_emb"]
#: Greatest values that openings set, and the candidates' columns they hold for.
UPPER = {"max_age": "age", "max_ral": "salary_low", "available_day": "available_day"}
LISTS = ("skills", "languages", "certifications")
CANDIDATE_TILE = 8192
VACANCY_TILE = 256
CELL_DEGREES = 0.5
KM_PER_DEGREE = 111.0
TIE_DIGITS = 9
SENT_VACANCIES = 2048
#: Openings in a pack, as a multiple of those scored at once.
PACKED_TILES = 128
#: A pack of long vectors holds fewer rows; a task keeps so much of the openings it has read.
PACK_BYTES = 32 << 20
KEPT_BYTES = 128 << 20
#: Candidates scored at once.
SCORED_PEOPLE = 512
#: Parts of the candidates that a set of openings meets in different tasks.
CANDIDATE_PARTS = 4


# --- one request -----------------------------------------------------------------

def similarities(candidates: DataFrame, job: list[float], skills: list[float]) -> DataFrame:
    """The four cosines of each candidate with the vectors of one request, as matrix
    products over Arrow batches. All vectors have the request's length."""
    wanted = [np.asarray(job, np.float64)] * 3 + [np.asarray(skills, np.float64)]
    people = with_vectors(candidates, CANDIDATE_VECTORS).select("candidate_id", *CANDIDATE_VECTORS)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = [batch["candidate_id"]]
            for name, vector in zip(CANDIDATE_VECTORS, wanted):
                rows = batch[name].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                out.append(pa.array(rows @ vector / (np.linalg.norm(rows, axis=1) * np.linalg.norm(vector) + EPSILON)))
            yield pa.RecordBatch.from_arrays(out, names=["candidate_id", *SIMS])

    kind = people.schema["candidate_id"].dataType.simpleString()
    return people.mapInArrow(run, f"candidate_id {kind}, " + ", ".join(f"{s} double" for s in SIMS))


def weighted(weights: tuple[float, ...]) -> Column:
    terms = [F.lit(w) * F.col(s) for w, s in zip(weights, SIMS)]
    return terms[0] + terms[1] + terms[2] + terms[3]


def best(sims: DataFrame, k: int | None, weights: tuple[float, ...]) -> DataFrame:
    """Positive scores, best first, rounded half-even; ties by candidate.

    A plain filter on the score would be pushed below the exchange and take all
    cosines with it.
    """
    scored = where_computed(sims, "score", weighted(weights), lambda x: x > 0)
    ranked = scored.select("candidate_id", "score").orderBy(
        F.round("score", TIE_DIGITS).desc(), F.col("candidate_id"))
    if k is not None:
        ranked = ranked.limit(k)
    return ranked.withColumn("score", F.bround("score", 0).cast("long"))


def score_request(
    candidates: DataFrame, request: DataFrame, k: int | None = vocab.MATCH_LIMIT,
    weights: tuple[float, ...] = vocab.SCORE_WEIGHTS, scale: bool = True,
) -> DataFrame:
    """Top candidates of a one-row request (jobtitle_emb, skills_emb).

    The one-row request is sent to the candidates, which are scanned where they are;
    only four numbers per candidate remain for the minimum and the top k.
    """
    asked = request.select("jobtitle_emb", "skills_emb").first()
    if asked is None or asked[0] is None or asked[1] is None:
        return best(similarities(candidates.limit(0), [], []), k, weights)
    sims = similarities(candidates, asked[0], asked[1])
    if scale:
        # The exchange holds the small rows; the minimum and the score reuse it
        # instead of reading the vectors twice.
        sims = sims.repartition(F.col("candidate_id"))
        lows = sims.agg(F.struct(*[F.min(s).alias(s) for s in SIMS]).alias("lows")).scalar()
        sims = sims.withColumn("_lows", lows)
        sims = sims.select("candidate_id", *[
            vectors.min_scale(F.col(s), F.col(f"_lows.{s}")).alias(s) for s in SIMS])
    else:
        sims = sims.select("candidate_id", *[F.coalesce(s, F.lit(0.0)).alias(s) for s in SIMS])
    return best(sims, k, weights)


# --- many requests: blocks ---------------------------------------------------------

def _cell(c: Column, low: int, cell: float) -> Column:
    return F.floor((c - F.lit(low)) / F.lit(cell)).cast("int")


def _cell_name(lat: Column, lon: Column) -> Column:
    return F.concat_ws(":", F.lit("C"), lat, lon)


def _everywhere() -> Column:
    """Candidates every vacancy admits by place."""
    return F.coalesce(
        (F.col("desired_location") == "Internazionale")
        | ((F.col("desired_location") == "Nazionale") & (F.lower("country") == "italia")), F.lit(False))


def candidate_blocks(candidates: DataFrame, cell: float = CELL_DEGREES) -> DataFrame:
    """The blocks in which a vacancy may admit a prepared candidate, as an array.

    Candidates every vacancy admits sit in the block 'G' only; the others in
    their region (if regional), grid cell and city.
    """
    regional = F.coalesce(F.col("desired_location") == "Regionale", F.lit(False)) & (F.col("region") != "")
    placed = geo.is_number(F.col("latitude")) & geo.is_number(F.col("longitude"))
    keys = F.array_compact(F.array(
        F.when(regional, F.concat(F.lit("R:"), "region")),
        F.when(placed, _cell_name(_cell(F.col("latitude"), -90, cell), _cell(F.col("longitude"), -180, cell))),
        F.when(F.col("location") != "", F.concat(F.lit("L:"), "location")),
    ))
    return candidates.withColumn("blocks", F.when(F.col("everywhere"), F.array(F.lit("G"))).otherwise(keys))


def vacancy_blocks(vacancies: DataFrame, cell: float = CELL_DEGREES) -> DataFrame:
    """The blocks a prepared vacancy draws from, as an array: everyone, its region, and the
    grid cells its radius touches, or its city when it has no coordinates. Without a radius
    nobody is near."""
    placed = geo.is_number(F.col("latitude")) & geo.is_number(F.col("longitude"))
    reach = F.col("max_distance") / F.lit(KM_PER_DEGREE)
    south = F.greatest(F.col("latitude") - reach, F.lit(-90.0))
    north = F.least(F.col("latitude") + reach, F.lit(90.0))
    # Widest at the latitude of the circle nearest a pole; near a pole take all longitudes.
    narrow = F.cos(F.radians(F.greatest(F.abs(south), F.abs(north))))
    wide = F.when(narrow > 0.01, F.least(reach / narrow, F.lit(180.0))).otherwise(F.lit(180.0))
    columns = round(360 / cell)
    first = _cell(F.col("longitude") - wide, -180, cell)
    last = F.least(_cell(F.col("longitude") + wide, -180, cell), first + F.lit(columns - 1))
    cells = F.flatten(F.transform(
        F.sequence(_cell(south, -90, cell), _cell(north, -90, cell)),
        lambda y: F.transform(
            F.sequence(first, last), lambda x: _cell_name(y, F.pmod(x, F.lit(columns)).cast("int")))))
    city = F.when(F.col("location") != "", F.concat(F.lit("L:"), "location"))
    keys = F.array_compact(F.array(F.lit("G"), F.when(F.col("region") != "", F.concat(F.lit("R:"), "region"))))
    near = (
        F.when(F.coalesce(placed, F.lit(False)) & F.col("max_distance").isNotNull(), cells)
        .when(F.coalesce(placed, F.lit(False)), F.array().cast("array<string>"))
        .otherwise(F.array_compact(F.array(city))))
    return vacancies.withColumn("blocks", F.concat(keys, near))


# --- many requests: tiles ------------------------------------------------------------

def tile_counts(left: DataFrame, right: DataFrame, left_tile: int, right_tile: int) -> DataFrame:
    """Number of tiles per block on each side; blocks missing on one side vanish."""
    lefts = left.groupBy("block").agg(F.ceil(F.count("*") / left_tile).cast("int").alias("n_left"))
    rights = right.groupBy("block").agg(F.ceil(F.count("*") / right_tile).cast("int").alias("n_right"))
    return lefts.join(rights, "block")


def _slot(key: str, n: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(n)).cast("int")


def tiles(candidates: DataFrame, vacancies: DataFrame, candidate_tile: int, vacancy_tile: int):
    """Both sides with (block, c_tile, v_tile): each candidate tile meets each vacancy
    tile of its block once. A hot block only has more tiles, never a bigger one."""
    counts = tile_counts(candidates.select("block"), vacancies.select("block"), candidate_tile, vacancy_tile)
    left = (
        candidates.join(counts, "block")
        .withColumn("c_tile", _slot("candidate_id", "n_left"))
        .withColumn("v_tile", F.explode(F.sequence(F.lit(0), F.col("n_right") - 1)))
        .drop("n_left", "n_right")
    )
    right = (
        vacancies.join(counts, "block")
        .withColumn("v_tile", _slot("vacancy_id", "n_right"))
        .withColumn("c_tile", F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)))
        .drop("n_left", "n_right")
    )
    return left, right


# Null lists and unknown shifts count as "no preference" (0 bits).
def shift_bits(c: Column, shifts: list[str] = vocab.SHIFTS) -> Column:
    low = F.transform(c, lambda x: F.lower(F.trim(x)))
    bits = [F.when(F.array_contains(low, s.lower()), F.lit(1 << i)).otherwise(F.lit(0)) for i, s in enumerate(shifts)]
    # A list that names only other shifts is not "no preference": mark it with a spare bit.
    spare = F.when(F.size(c) > 0, F.lit(1 << len(shifts))).otherwise(F.lit(0))
    total = spare
    for b in bits:
        total = total + b
    return F.coalesce(total, F.lit(0))


CANDIDATE_COLUMNS = [
    "candidate_id", "region", "province_ext", "desired_location", "latitude", "longitude", "age",
    "salary_low", "available_day", "parttime_preferenza_perc", "shift_bits", "education_rank",
    "skills", "languages", "certifications",
    "last_job_emb", "second_last_job_emb", "third_last_job_emb", "skills_emb",
]
VACANCY_COLUMNS = [
    "vacancy_id", "region", "provinces", "latitude", "longitude", "max_distance", "max_age", "max_ral",
    "available_day", "parttime_preferenza_perc", "shift_bits", "education_rank",
    "skills_mand", "languages_mand", "certifications_mand", "jobtitle_emb", "skills_emb",
]


def _days(c: Column) -> Column:
    return F.unix_date(c.cast("date"))


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def with_vectors(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows that have all vectors; others can't be scored and take no part, nor in the minima."""
    for name in names:
        df = df.where(F.col(name).isNotNull())
    return df


def prepare_candidates(candidates: DataFrame) -> DataFrame:
    scored = with_vectors(candidates, CANDIDATE_VECTORS)
    return scored.withColumns({
        "region": text.place_name(F.col("region")), "location": text.place_name(F.col("location")),
        "province_ext": text.place_name(_or_null(candidates, "province_ext", "string")),
        "available_day": _days(F.col("date_available")),
        "shift_bits": shift_bits(F.col("turno_preferenza")),
        "education_rank": filters.level_rank(F.col("education"), vocab.EDUCATION_LEVELS),
        "everywhere": _everywhere(),
    })


def prepare_vacancies(vacancies: DataFrame) -> DataFrame:
    wanted = shift_bits(F.col("turno_preferenza")).bitwiseAND(F.lit((1 << len(vocab.SHIFTS)) - 1))
    return with_vectors(vacancies, ["jobtitle_emb", "skills_emb"]).withColumns({
        "region": text.place_name(F.col("region")), "location": text.place_name(F.col("location")),
        "provinces": F.transform(_or_null(vacancies, "provinces", "array<string>"), text.place_name),
        "available_day": _days(F.col("date_available")),
        "shift_bits": wanted,
        "education_rank": filters.level_rank(F.col("education_mand"), vocab.EDUCATION_LEVELS),
        **{c: F.transform(F.col(c), lambda t: F.lower(F.trim(t)))
           for c in ("skills_mand", "languages_mand", "certifications_mand")},
    })


# --- many requests: a batch of candidates and a set of openings ------------------------

def _rows(arrow) -> pd.DataFrame:
    """Arrow rows as a frame; lists, the vectors among them, stay as they are."""
    return arrow.to_pandas(types_mapper=lambda t: pd.ArrowDtype(t) if pa.types.is_list(t) else None)


def _vectors(column: pd.Series) -> np.ndarray:
    lists = pa.chunked_array(pa.array(column)).combine_chunks()
    if len(pa.compute.unique(pa.compute.list_value_length(lists))) > 1:
        raise ValueError(f"vectors of {column.name} differ in length")
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in single precision, and norms. Zero vectors and those that hold a
    number that is none become zero; the norm tells them."""
    exact = rows.astype(np.float64)
    norms = np.sqrt(np.einsum("nd,nd->n", exact, exact))
    units = exact / np.where(norms > 0, norms, 1.0)[:, None]
    return np.where(np.isfinite(norms)[:, None], units, 0.0).astype(np.float32), norms


def _bound(column: pd.Series, unset: float, zero_is_unset: bool = True) -> np.ndarray:
    values = column.to_numpy(float, na_value=np.nan)
    return np.where(np.isnan(values) | ((values == 0) & zero_is_unset), unset, values)


def _names(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return pd.factorize(column.fillna(""))


def _codes(named: tuple[np.ndarray, np.ndarray], known: dict) -> np.ndarray:
    """Numbers of names that the candidates have, -1 for others and for no name."""
    numbers, names = named
    return np.array([known.get(x, -1) if x else -1 for x in names], np.int64)[numbers]


class _People:
    """A batch of candidates, neighbours in what openings ask together: those every opening
    admits by place by age, others by region and place, in tiles."""

    def __init__(self, rows: pd.DataFrame):
        everywhere = rows["everywhere"].to_numpy(bool)
        regional = (rows["desired_location"].fillna("") == "Regionale").to_numpy() & ~everywhere
        lat, lon, age = (rows[c].to_numpy(float, na_value=np.nan) for c in ("latitude", "longitude", "age"))
        own = np.where(regional, pd.factorize(rows["region"])[0], -1)
        order = np.lexsort((np.where(everywhere, age, _interleaved(lat, lon)), own, ~everywhere))
        rows = rows.iloc[order].reset_index(drop=True)
        self.rows, self.ids, self.everywhere = rows, rows["candidate_id"].to_numpy(), everywhere[order]
        self.lat, self.lon, self.known = lat[order], lon[order], {}
        self.regions = {x: i for i, x in enumerate(rows["region"].unique()) if x}
        self.cities = {x: i for i, x in enumerate(rows["location"].unique()) if x}
        region, city = _codes(_names(rows["region"]), self.regions), _codes(_names(rows["location"]), self.cities)
        # No name is another number here than with openings: two unknown places aren't one.
        self.region = np.where(regional[order] & (region >= 0), region, -2)
        self.city = np.where(city >= 0, city, -2)
        self.most = {bound: _bound(rows[c], -np.inf, False) for bound, c in UPPER.items()}
        self.part_time = _bound(rows["parttime_preferenza_perc"], np.inf)
        self.shifts, self.rank = rows["shift_bits"].to_numpy(np.int64), _bound(rows["education_rank"], -np.inf, False)
        self.raw = [_vectors(rows[c]) for c in CANDIDATE_VECTORS]
        units, norms = zip(*map(_units, self.raw))
        self.units, self.norms, self.bad = np.hstack(units), np.stack(norms), ~np.isfinite(np.stack(norms))
        self.shortest = min((x[(x > 0) & np.isfinite(x)].min(initial=np.inf) for x in self.norms), default=np.inf)
        self.tiles = [_Tile(self, i, min(i + SCORED_PEOPLE, len(rows))) for i in range(0, len(rows), SCORED_PEOPLE)]

    def mentions(self, column: str, term: str) -> np.ndarray:
        if (column, term) not in self.known:
            texts = self.rows[column].fillna("").str.lower()
            self.known[column, term] = texts.str.contains(term, regex=False).to_numpy(bool)
        return self.known[column, term]

    def lists(self, wants: tuple) -> np.ndarray:
        """Who lives in one of the provinces (none: all) and mentions every term."""
        if wants not in self.known:
            provinces, *lists = wants
            ok = self.rows["province_ext"].isin(provinces).to_numpy() if provinces else np.ones(len(self.rows), bool)
            for column, terms in zip(LISTS, lists):
                for term in terms:
                    ok = ok & self.mentions(column, term)
            self.known[wants] = ok
        return self.known[wants]


class _Tile:
    """Neighbouring candidates, and what all of them have in common."""

    def __init__(self, c: _People, start: int, stop: int):
        self.start, self.stop, at = start, stop, slice(start, stop)
        self.everywhere = c.everywhere[at].any()
        self.least = {name: values[at].min() for name, values in c.most.items()}
        self.region, self.city = np.unique(c.region[at]), np.unique(c.city[at])
        placed = ~(np.isnan(c.lat[at]) | np.isnan(c.lon[at]))
        self.box = None
        if placed.any():
            lat, lon = c.lat[at][placed], c.lon[at][placed]
            self.box = lat.min(), lat.max(), lon.min(), lon.max()


class _Openings:
    """Openings as arrays, and what they ask of a batch of candidates."""

    def __init__(self, rows: pd.DataFrame):
        self.ids, self.regions, self.cities = rows["vacancy_id"].to_numpy(), _names(rows["region"]), _names(rows["location"])
        self.lat, self.lon, self.reach = (rows[c].to_numpy(float, na_value=np.nan) for c in ("latitude", "longitude", "max_distance"))
        self.placed = ~(np.isnan(self.lat) | np.isnan(self.lon))
        self.most = {c: _bound(rows[c], np.inf) for c in UPPER}
        self.part_time, self.rank = _bound(rows["parttime_preferenza_perc"], -np.inf), _bound(rows["education_rank"], -np.inf)
        self.shifts = rows["shift_bits"].to_numpy(np.int64)
        lists = [pa.array(rows[c]) for c in ("provinces", *(f"{c}_mand" for c in LISTS))]
        named = [pa.compute.max(pa.compute.list_value_length(x)).as_py() for x in lists]
        asked = [x.to_pylist() if n else [None] * len(rows) for x, n in zip(lists, named)]
        wants = [tuple(frozenset(x or ()) for x in row) for row in zip(*asked)] if any(named) else []
        self.wants = list(dict.fromkeys(wants)) or [(frozenset(),) * len(lists)]
        numbers = {x: i for i, x in enumerate(self.wants)}
        self.want = np.array([numbers[x] for x in wants], np.int64) if wants else np.zeros(len(rows), np.int64)
        self.raw = [_vectors(rows[c]) for c in ("jobtitle_emb", "skills_emb")]
        (self.job, job), (self.skills, skills) = map(_units, self.raw)
        self.norms = np.stack([job, job, job, skills])
        self.fine = np.isfinite(self.norms).all(axis=0)
        if "low_last" in rows:
            self.lows = np.stack([rows[f"low_{s}"].to_numpy(float) for s in SIMS])
            self.fine &= np.isfinite(self.lows).all(axis=0)

    def __len__(self) -> int:
        return len(self.ids)

    def size(self) -> int:
        return sum(x.nbytes for x in (*self.raw, self.job, self.skills))

    def meet(self, c: _People) -> None:
        """The names and lists of openings by the numbers of a batch."""
        self.region = _codes(self.regions, c.regions)
        self.city = np.where(self.placed, -1, _codes(self.cities, c.cities))
        self.lists = np.stack([c.lists(x) for x in self.wants])

    def slack(self, c: _People) -> np.ndarray:
        """How far a similarity in single precision may be from the exact one: by rounding of
        the vectors and sums of products of a length's many terms, and by EPSILON."""
        terms = c.units.shape[1] + 16
        return terms * 2.0 ** -23 + EPSILON / (c.shortest * np.where(self.norms > 0, self.norms, np.inf).min(axis=0) + EPSILON)


def _interleaved(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Order of places in which neighbours are mostly near; unknown places come last."""
    known = ~(np.isnan(lat) | np.isnan(lon))
    out = np.zeros(len(lat), np.int64)
    for i, (x, low, span) in enumerate(((lat, -90, 180), (lon, -180, 360))):
        step = (np.clip((np.where(known, x, 0.0) - low) / span, 0, 1) * (2 ** 20 - 1)).astype(np.int64)
        for bit in range(20):
            out |= ((step >> bit) & 1) << (2 * bit + i)
    return np.where(known, out, 2.0 ** 40)


def _half_chord(lat_gap: np.ndarray, lon_gap: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    return np.sin(np.radians(lat_gap) / 2) ** 2 + cosines * np.sin(np.radians(lon_gap) / 2) ** 2


def _kilometres(chord: np.ndarray) -> np.ndarray:
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1.0, chord)))


def _near(c: _People, v: _Openings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    chord = _half_chord(c.lat[i] - v.lat[j], c.lon[i] - v.lon[j], np.cos(np.radians(c.lat[i])) * np.cos(np.radians(v.lat[j])))
    return _kilometres(chord) <= v.reach[j]


def _admitted(c: _People, v: _Openings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs the structured filter admits; i and j are broadcast. Unknown values of a
    candidate and unset bounds (null or 0) pass."""
    ok = v.lists[v.want[j], i]
    for name, have in c.most.items():
        if np.isfinite(v.most[name]).any():
            ok = ok & (have[i] <= v.most[name][j])
    ok = ok & (c.part_time[i] >= v.part_time[j]) & (c.rank[i] >= v.rank[j])
    ok &= (c.shifts[i] == 0) | ((c.shifts[i] & v.shifts[j]) == v.shifts[j])
    place = c.everywhere[i] | (c.region[i] == v.region[j]) | (c.city[i] == v.city[j])
    open_ = np.nonzero(ok & ~place & v.placed[j])
    i, j = (np.broadcast_to(x, ok.shape)[open_] for x in (i, j))
    # The way between two latitudes is a distance by itself.
    far = np.radians(np.abs(c.lat[i] - v.lat[j])) * EARTH_RADIUS_KM > v.reach[j] * (1 + 1e-9) + 1e-6
    far &= (np.abs(c.lat[i]) <= 90) & (np.abs(v.lat[j]) <= 90)
    near = np.zeros(len(i), bool)
    near[~far] = _near(c, v, i[~far], j[~far])
    ok &= place
    ok[open_] = near
    return ok


def _asking(c: _People, v: _Openings, tile: _Tile) -> np.ndarray:
    """The openings that may admit someone of the tile, by its place and least values."""
    ok = v.fine.copy()
    for name, least in tile.least.items():
        ok &= least <= v.most[name]
    if not tile.everywhere:
        place = np.isin(v.region, tile.region) | np.isin(v.city, tile.city)
        if tile.box is not None:
            south, north, west, east = tile.box
            lat, lon = np.where(v.placed, v.lat, 0.0), np.where(v.placed, v.lon, 0.0)
            lat_gap = np.maximum(0, np.maximum(south - lat, lat - north))
            # The way to the nearer side of the box, round the other side of the earth too.
            lon_gap = np.where((west <= lon) & (lon <= east), 0.0, np.minimum((west - lon) % 360, (lon - east) % 360))
            cosines = np.cos(np.radians(lat)) * np.cos(np.radians(max(abs(south), abs(north))))
            near = _kilometres(_half_chord(lat_gap, lon_gap, cosines)) <= v.reach * (1 + 1e-9) + 1e-6
            if max(-south, north) > 90 or max(-west, east) > 180:  # no places on a globe
                near = v.reach >= 0
            near |= (np.abs(lat) > 90) | (np.abs(lon) > 180)
            place |= near & v.placed
        ok &= place
    return np.flatnonzero(ok & v.lists[:, tile.start:tile.stop].any(axis=1)[v.want])


def _pairs(c: _People, v: _Openings, tile: _Tile, j: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Admitted pairs among those wanted (openings j by the tile's candidates), as positions there."""
    if wanted.mean() > 0.25:
        return np.nonzero(wanted & _admitted(c, v, np.arange(tile.start, tile.stop)[None, :], j[:, None]))
    r, p = np.nonzero(wanted)
    ok = _admitted(c, v, tile.start + p, j[r])
    return r[ok], p[ok]


def _exact(c: _People, v: _Openings, sim: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A similarity of pairs in double precision."""
    people, asked = c.raw[sim], v.raw[sim == 3]
    out, step = np.empty(len(i)), max(1, 2 ** 21 // people.shape[1])
    for at in (slice(n, n + step) for n in range(0, len(i), step)):
        dots = np.einsum("nd,nd->n", people[i[at]].astype(np.float64), asked[j[at]].astype(np.float64))
        out[at] = dots / (c.norms[sim][i[at]] * v.norms[sim][j[at]] + EPSILON)
    return out


class _Lows:
    """Minimum of each similarity per opening over the admitted candidates seen so far.

    Products in single precision name the few pairs that may be below what was found;
    only those are tested for admission and computed exactly.
    """

    def __init__(self, v: _Openings):
        self.ids, shape = v.ids, (len(SIMS), len(v))
        self.about, self.lows = np.full(shape, np.inf, np.float32), np.full(shape, np.inf)

    def add(self, c: _People, v: _Openings, size: int) -> None:
        slack, found = 2 * v.slack(c), [[] for _ in SIMS]
        sims = np.empty((len(SIMS), size, SCORED_PEOPLE), np.float32)
        dims = v.job.shape[1]
        for tile in c.tiles:
            people = c.units[tile.start:tile.stop]
            for j in _chunks(_asking(c, v, tile), size):
                job, skills, some = v.job[j], v.skills[j], sims[:, :len(j), :len(people)]
                for n in range(3):
                    np.matmul(job, people[:, n * dims:(n + 1) * dims].T, out=some[n])
                np.matmul(skills, people[:, 3 * dims:].T, out=some[3])
                limit = (self.about[:, j] + slack[j]).astype(np.float32)
                below = some.min(axis=2) <= limit
                hit = np.flatnonzero(below.any(axis=0))
                if len(hit) == 0:
                    continue
                wanted = np.zeros((len(hit), len(people)), bool)
                for n in range(len(SIMS)):
                    at = np.flatnonzero(below[n, hit])
                    wanted[at] |= some[n, hit[at]] <= limit[n, hit[at], None]
                r, p = _pairs(c, v, tile, j[hit], wanted)
                if len(r) == 0:
                    continue
                owner, person = j[hit][r], tile.start + p
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                for n in range(len(SIMS)):
                    values = np.where(c.bad[n][person], np.float32(np.inf), some[n, hit[r], p])
                    rows = owner[starts]
                    self.about[n, rows] = np.minimum(self.about[n, rows], np.minimum.reduceat(values, starts))
                    keep = np.isfinite(values) & (values <= self.about[n, owner] + slack[owner])
                    found[n].append((person[keep], owner[keep], values[keep]))
        for n, parts in enumerate(found):
            if parts:
                i, j, values = map(np.concatenate, zip(*parts))
                keep = values <= self.about[n, j] + slack[j]
                i, j = i[keep], j[keep]
                np.fmin.at(self.lows[n], j, _exact(c, v, n, i, j))

    def result(self) -> pd.DataFrame:
        some = np.isfinite(self.lows).any(axis=0)
        return pd.DataFrame({"vacancy_id": self.ids[some], **{s: low[some] for s, low in zip(SIMS, self.lows)}})


class _Best:
    """The k best admitted candidates per opening seen so far; the openings carry the minima.

    With the minima known the score is one product of weighted vectors. As for the minima,
    single precision names the pairs that may be among the best, others are never looked at.
    """

    def __init__(self, v: _Openings, weights: tuple[float, ...], k: int):
        self.ids, self.weights, self.k = v.ids, weights, k
        self.about = np.full((len(v), k), -np.inf, np.float32)
        self.found: list[tuple] = []

    def add(self, c: _People, v: _Openings, size: int) -> None:
        k, lows = self.k, np.where(v.fine, v.lows, 0.0)
        scale = np.array(self.weights)[:, None] / (1.0 - lows + EPSILON)
        slack = 2 * (v.slack(c) * np.abs(scale).sum(axis=0) + 1.0 / 10 ** TIE_DIGITS)
        # Scores above zero only; the constant part of a score is left out of all comparisons.
        zero = (scale * lows).sum(axis=0) - slack
        least = lambda rows: np.maximum(self.about[rows, 0] - slack[rows], zero[rows]).astype(np.float32)
        factors = scale[:, :, None].astype(np.float32)
        weighted = np.hstack([*(v.job * factors[n] for n in range(3)), v.skills * factors[3]])
        scores, found = np.empty((size, SCORED_PEOPLE), np.float32), []
        for tile in c.tiles:
            people = c.units[tile.start:tile.stop]
            for j in _chunks(_asking(c, v, tile), size):
                some, limit = np.matmul(weighted[j], people.T, out=scores[:len(j), :len(people)]), least(j)
                hit = np.flatnonzero(some.max(axis=1) >= limit)
                if len(hit) == 0:
                    continue
                r, p = _pairs(c, v, tile, j[hit], some[hit] >= limit[hit, None])
                fine = ~c.bad[:, tile.start + p].any(axis=0)
                r, p = r[fine], p[fine]
                if len(r) == 0:
                    continue
                owner, values = j[hit][r], some[hit[r], p]
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                counts = np.diff(starts, append=len(owner))
                new = np.full((len(starts), counts.max()), -np.inf, np.float32)
                new[np.repeat(np.arange(len(starts)), counts), np.arange(len(owner)) - np.repeat(starts, counts)] = values
                rows = owner[starts]
                both = np.hstack([self.about[rows], new])
                self.about[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                keep = values >= least(owner)
                found.append((tile.start + p[keep], owner[keep], values[keep]))
        if not found:
            return
        i, j, values = map(np.concatenate, zip(*found))
        keep = values >= least(j)
        i, j, values = i[keep], j[keep], values[keep]
        raw = np.zeros(len(i))
        for n, weight in enumerate(self.weights):
            low = v.lows[n][j]
            raw += weight * ((_exact(c, v, n, i, j) - low) / (1.0 - low + EPSILON))
        keep = raw > 0
        self.found.append((j[keep], c.ids[i[keep]], raw[keep], values[keep], slack[j[keep]]))
        if sum(len(x[0]) for x in self.found) > 2 * k * len(v):
            self.compact()
            if len(self.found[0][0]) > 2 * k * len(v):  # ties
                self.found = [tuple(x[self.order()] for x in self.found[0])]

    def compact(self) -> None:
        """Drops what is below k others by more than single precision may be wrong."""
        j, ids, raw, values, slack = (np.concatenate(x) for x in zip(*self.found))
        keep = values >= self.about[j, 0] - slack
        self.found = [(j[keep], ids[keep], raw[keep], values[keep], slack[keep])]

    def order(self) -> np.ndarray:
        """Positions of the k best per opening, ties by candidate."""
        j, ids, raw = self.found[0][:3]
        order = np.lexsort((ids, -np.round(raw, TIE_DIGITS), j))
        starts = np.flatnonzero(np.diff(j[order], prepend=-1))
        rank = np.arange(len(j)) - np.repeat(starts, np.diff(starts, append=len(j)))
        return order[rank < self.k]

    def result(self) -> pd.DataFrame:
        if not self.found:
            return pd.DataFrame(columns=["vacancy_id", "candidate_id", "raw"])
        self.compact()
        j, ids, raw = (x[self.order()] for x in self.found[0][:3])
        return pd.DataFrame({"vacancy_id": self.ids[j], "candidate_id": ids, "raw": raw})


def _chunks(rows: np.ndarray, size: int) -> list[np.ndarray]:
    return [rows[i:i + size] for i in range(0, len(rows), size)]


def _found(pairs, start, size: int):
    """Results of start(openings), to which every batch of pairs is added, one for each set of
    openings. pairs: (candidates, name of the set, openings)."""
    sets = {}
    for c, name, v in pairs:
        if len(c.rows) and len(v):
            if name not in sets:
                sets[name] = start(v)
            v.meet(c)
            sets[name].add(c, v, size)
    for name in list(sets):
        result = sets.pop(name).result()
        if len(result):
            yield result


def _found_in(df: DataFrame, pairs, start, size: int, kind: str) -> DataFrame:
    """_found on the pairs that pairs(batches) makes of df's rows."""
    schema = to_arrow_schema(T._parse_datatype_string(kind))

    def run(batches):
        for rows in _found(pairs(batches), start, size):
            yield pa.RecordBatch.from_pandas(rows, schema=schema, preserve_index=False)

    return df.mapInArrow(run, kind)


def _by_place(df: DataFrame, first: Column, cell: float) -> DataFrame:
    """Rows in the order of a first column, then grid cells, cut into ranges: neighbours share packs."""
    df = df.withColumns({
        "_first": first, "_lat": _cell(F.col("latitude"), -90, cell), "_lon": _cell(F.col("longitude"), -180, cell)})
    order = ["_first", "_lat", "_lon", df.columns[0]]
    return df.repartitionByRange(*order).sortWithinPartitions(*order).drop("_first", "_lat", "_lon")


def packs(df: DataFrame, size: int) -> DataFrame:
    """Neighbouring rows as one: (pack, blocks, body), body being up to size rows and about
    PACK_BYTES as an Arrow stream without their blocks, blocks what any of them has. Rows
    without a block go."""
    def run(batches):
        held, n = [], 0
        for batch in batches:
            most = min(size, max(1, PACK_BYTES * batch.num_rows // max(1, batch.nbytes)))
            held.append(batch)
            n += batch.num_rows
            while n >= most:
                rows = pa.Table.from_batches(held)
                yield packed(rows.slice(0, most))
                held, n = rows.slice(most).to_batches(), n - most
        if n:
            yield packed(pa.Table.from_batches(held))

    def packed(rows):
        names = pa.compute.unique(rows["blocks"].combine_chunks().flatten())
        sink = pa.BufferOutputStream()
        body = rows.drop_columns(["blocks"]).combine_chunks()
        with pa.ipc.new_stream(sink, body.schema) as out:
            out.write_table(body)
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.array([names.to_pylist()], pa.list_(pa.string())), pa.array([sink.getvalue().to_pybytes()])],
            names=["pack", "blocks", "body"])

    return df.where(F.size("blocks") > 0).mapInArrow(run, "pack string, blocks array<string>, body binary")


def _rows_of(body) -> pd.DataFrame:
    return _rows(pa.ipc.open_stream(body.as_buffer()).read_all())


def _met(candidates: DataFrame, vacancies: DataFrame, start, size: int, kind: str) -> DataFrame:
    """What start(openings) finds over the pairs of packs that share a block. The packs are read
    by each task that needs them and none is copied for its pairs; a task has all pairs of its
    packs, those of one pack of candidates in a row. Candidates are dealt so that every task has
    some whom all openings admit by place, and has them first: they tell early what is too far off."""
    right = vacancies.select(F.col("pack").alias("v_pack"), F.col("blocks").alias("v_blocks"), F.col("body").alias("v_body"))
    dealt = candidates.repartition(CANDIDATE_PARTS, "pack").sortWithinPartitions(F.array_contains("blocks", "G").desc())
    pairs = dealt.join(
        right.hint("shuffle_replicate_nl"), F.arrays_overlap("blocks", "v_blocks")).select("pack", "body", "v_pack", "v_body")

    def opened(batches):
        last, people, kept, held = None, None, {}, 0
        for batch in batches:
            for i in range(batch.num_rows):
                pack, name = batch["pack"][i].as_py(), batch["v_pack"][i].as_py()
                if pack != last:
                    last, people = pack, _People(_rows_of(batch["body"][i]))
                v = kept.get(name) or _Openings(_rows_of(pa.scalar(batch["v_body"][i].as_py())))
                if name not in kept and held + v.size() <= KEPT_BYTES:
                    kept[name], held = v, held + v.size()
                yield people, name, v

    return _found_in(pairs, opened, start, size, kind)


def _match_tiled(vacancies, candidates, k, weights, candidate_tile, vacancy_tile, cell, types):
    regional = F.when(F.col("everywhere"), F.lit("G")).when(F.col("desired_location") == "Regionale", F.col("region"))
    people = candidate_blocks(_by_place(candidates.select(*CANDIDATE_COLUMNS, "everywhere", "location"), regional, cell), cell)
    openings = vacancies.select(*VACANCY_COLUMNS, "location")
    left = staged(packs(people, candidate_tile), "candidates")

    def right(rows):
        return staged(packs(vacancy_blocks(_by_place(rows, F.col("region"), cell), cell), PACKED_TILES * vacancy_tile), "vacancies")

    lows = _met(left, right(openings), _Lows, vacancy_tile, types["lows"]).groupBy("vacancy_id").agg(
        *[F.min(s).alias(f"low_{s}") for s in SIMS])
    return _met(left, right(openings.join(lows, "vacancy_id")), lambda v: _Best(v, weights, k), vacancy_tile, types["top"])


def _match_sent(vacancies, candidates, k, weights, vacancy_tile, types):
    """vacancies is small and counted: both passes run where the candidates lie."""
    people = candidates.select("everywhere", "location", *CANDIDATE_COLUMNS)
    sent = vacancies.select("location", *VACANCY_COLUMNS).where(F.col("vacancy_id").isNotNull()).toArrow()

    def met(openings, start, kind):
        def each(batches):
            v = _Openings(_rows(openings))
            for c in batches:
                yield _People(_rows(c)), 0, v

        return _found_in(people, each, start, vacancy_tile, kind)

    lows = met(sent, _Lows, types["lows"]).groupBy("vacancy_id").agg(*[F.min(s).alias(f"low_{s}") for s in SIMS])
    # One row per vacancy at most, so bounded as the vacancies are.
    low = lows.toPandas().set_index("vacancy_id").reindex(sent["vacancy_id"].to_pandas())
    for s in SIMS:
        sent = sent.append_column(f"low_{s}", pa.array(low[f"low_{s}"].to_numpy(float)))
    return met(sent, lambda v: _Best(v, weights, k), types["top"])


def match_all(
    vacancies: DataFrame, candidates: DataFrame, k: int = vocab.MATCH_LIMIT,
    weights: tuple[float, ...] = vocab.SCORE_WEIGHTS, sent_vacancies: int = SENT_VACANCIES,
    candidate_tile: int = CANDIDATE_TILE, vacancy_tile: int = VACANCY_TILE, cell: float = CELL_DEGREES,
) -> DataFrame:
    """Filter, score and rank candidates for every vacancy: (vacancy_id, candidate_id, score, rank).

    Place names are compared without outer blanks and case; a vacancy may name provinces
    (array<string>) that candidates must live in. A null radius reaches nobody. Rows with a
    null vector take no part.

    Exact: similarities are scaled by their minimum over all admitted candidates of
    the vacancy, then the best k are kept per task and again overall. Up to
    sent_vacancies vacancies are sent to the candidates; more are matched in packs, which
    are written twice (openings) and once (candidates); the candidates' are shuffled twice, to
    deal them, whatever the pairs.
    cell is the grid step in degrees (a divisor of 360), best near the usual radius.
    """
    people, openings = prepare_candidates(candidates), prepare_vacancies(vacancies)
    v_type, c_type = (dict(f.dtypes)[n] for f, n in ((vacancies, "vacancy_id"), (candidates, "candidate_id")))
    types = {
        "lows": f"vacancy_id {v_type}, " + ", ".join(f"{s} double" for s in SIMS),
        "top": f"vacancy_id {v_type}, candidate_id {c_type}, raw double",
    }
    if vacancies.limit(sent_vacancies + 1).count() <= sent_vacancies:
        found = _match_sent(openings, people, k, weights, vacancy_tile, types)
    else:
        found = _match_tiled(openings, people, k, weights, candidate_tile, vacancy_tile, cell, types)
    order = Window.partitionBy("vacancy_id").orderBy(F.round("raw", TIE_DIGITS).desc(), F.col("candidate_id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("vacancy_id", "candidate_id", F.bround("raw", 0).cast("long").alias("score"), "rank")
    )

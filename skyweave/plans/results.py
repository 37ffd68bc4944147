"""Results that are kept: a request that was made before is read, not computed.

A result is known by a digest of the request, written canonically, and of the
version of the store that it is computed from. An append to the store makes
another version, so what was kept before is not found any more.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from skyweave.sources import manifest as M

from .engine import Engine
from .specs import GeoJSON

KINDS = ("raw", "climatology", "anomaly", "season", "season_climatology", "season_anomaly")
INDEX = "digest string, id string, kind string, request string"


def canonical(part) -> object:
    """A request's parts as plain lists, dicts, numbers and texts: fields by
    name, numbers as floats where they are equal to one (2 is 2.0), points as
    ``[name, lon, lat]``, dicts in order of their keys."""
    if dataclasses.is_dataclass(part):
        return {"": type(part).__name__} | {f.name: canonical(getattr(part, f.name)) for f in dataclasses.fields(part)}
    if isinstance(part, dict):
        if set(part) == {"loc", "lon", "lat"}:
            return canonical([str(part["loc"]), float(part["lon"]), float(part["lat"])])
        return {str(k): canonical(part[k]) for k in sorted(part, key=str)}
    if isinstance(part, (list, tuple)):
        return [canonical(x) for x in part]
    if isinstance(part, (int, float)) and not isinstance(part, bool):
        return float(part)
    return part


def version(spark: SparkSession, store: str) -> str:
    """What appends a store has seen through, in any order."""
    log = M._table(spark, store, "_log", M.LOG).where("state = 'done'")
    r = log.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}-{r['x']}-{r['s']}"


def of_store(spark: SparkSession, store: str, dataset: str, res: str, variables: tuple[str, ...], lat0: float, lon0: float, dlat: float, dlon: float, **known) -> Engine:
    """An engine over variables of a store. They are rows of one table and
    become columns in one aggregate, over the columns that a request uses."""
    rows = spark.read.parquet(store).where((F.col("dataset") == dataset) & (F.col("res") == res) & F.col("variable").isin(*variables))
    pick = [F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables]
    obs = rows.groupBy("time", "lat_i", "lon_i").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), *pick)
    return Engine(obs, lat0, lon0, dlat, dlon, variables, **known)


@dataclasses.dataclass(frozen=True)
class Results:
    """Results of an engine over ``store``, kept in ``folder``. ``engine`` must
    be made of that store alone; ``name`` tells engines over different parts
    of it apart."""

    engine: Engine
    store: str
    folder: str
    name: str = ""

    def digest(self, kind: str, *specs) -> tuple[str, str]:
        """``(digest, request)``. The features of a GeoJSON file count by their
        content, not by their path alone."""
        if kind not in KINDS:
            raise ValueError(f"no request {kind!r}; one of {', '.join(KINDS)}")
        spark = self.engine.obs.sparkSession
        read = []
        for s in specs:
            support = getattr(s, "support", None)
            if isinstance(support, GeoJSON):
                read.append(spark.read.option("wholetext", True).text(support.path).agg(F.max(F.sha2(F.col("value").cast("binary"), 256))).first()[0])
        grid = [self.engine.lat0, self.engine.lon0, self.engine.dlat, self.engine.dlon, self.engine.rows, self.engine.cols]
        request = json.dumps([kind, canonical(list(specs)), read, canonical(grid), self.name], sort_keys=True)
        whole = f"{request}\n{_plain(self.store)}\n{version(spark, self.store)}"
        return hashlib.sha256(whole.encode()).hexdigest(), request

    def _kept(self) -> DataFrame:
        return M._table(self.engine.obs.sparkSession, self.folder, "index", INDEX)

    def find(self, kind: str, *specs) -> DataFrame | None:
        """The kept result of a request; none if there is none."""
        digest, _ = self.digest(kind, *specs)
        row = self._kept().where(F.col("digest") == digest).orderBy("id").limit(1).collect()
        return self.engine.obs.sparkSession.read.parquet(f"{self.folder}/{row[0]['id']}") if row else None

    def request(self, kind: str, *specs) -> DataFrame:
        """``getattr(engine, kind)(*specs)``, from what is kept if it is there,
        and kept from now on if not. A result is listed once it is written
        whole; of two that are made at a time, one is read."""
        found = self.find(kind, *specs)
        if found is not None:
            return found
        spark = self.engine.obs.sparkSession
        digest, request = self.digest(kind, *specs)
        id_ = uuid.uuid4().hex
        getattr(self.engine, kind)(*specs).write.parquet(f"{self.folder}/{id_}")
        spark.createDataFrame([(digest, id_, kind, request)], INDEX).coalesce(1).write.mode("append").parquet(f"{self.folder}/index")
        return spark.read.parquet(f"{self.folder}/{id_}")

    def stale(self) -> DataFrame:
        """``(id, kind, request)`` of kept results that no request finds any
        more, as the store has moved on: their folders may go."""
        spark = self.engine.obs.sparkSession
        now = version(spark, self.store)
        whole = F.concat_ws("\n", "request", F.lit(_plain(self.store)), F.lit(now))
        return self._kept().where(F.sha2(whole.cast("binary"), 256) != F.col("digest")).select("id", "kind", "request")


def _plain(path: str) -> str:
    return path.removeprefix("file://").rstrip("/")

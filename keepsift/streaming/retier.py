"""Tiers that follow arriving scores without reading what has been scored before.

Ranked scores lie in pieces, ranges of (total descending, image id) of about `piece_rows` rows. A batch adds signed
rows to the pieces it touches, one that takes the old total of an asset out and one that puts the new one in; counts
per piece tell in which piece each cut lies now. Only the pieces between the old and the new place of a cut are read:
no other row can change its tier.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from keepsift import constants as K
from keepsift.session import store
from keepsift.streaming.live import BatchLog

#: Rows of a piece; one of more than twice as many is split.
PIECE_ROWS = 100_000
#: Batches that may add files to a piece before it is written anew.
PIECE_FILES = 16
START = (0, 0.0, "")


class _Replaced(StatefulProcessor):
    """The newest row of an asset in a batch, with the total that it replaces."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "total double, ranked boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = None
        for pdf in rows:
            top = pdf.sort_values("version").iloc[[-1]]
            new = top if new is None or top["version"].iloc[0] >= new["version"].iloc[0] else new
        if new is None:
            return
        old = self.last.get() if self.last.exists() else (None, False)
        total, ranked = new["total"].iloc[0], bool(new["ranked"].iloc[0])
        self.last.update((None if pd.isna(total) else float(total), ranked))
        new = new.assign(old_total=pd.Series([old[0]], index=new.index, dtype="float64"), old_ranked=bool(old[1]))
        yield new[self.columns]

    def close(self) -> None:
        pass


def _position(total: float | None, tie: str) -> tuple[int, float, str]:
    """Place in the ranking: high totals first, equal ones by id, rows without a total last."""
    return (2, 0.0, tie) if total is None or total != total else (1, -total, tie)


def _piece_of(bounds: dict[str, tuple[list[tuple], list[str]]]) -> Callable[..., Column]:
    """Piece of (scope, total, id). What travels to the tasks is one row per piece."""

    @F.pandas_udf("string")
    def piece(scope: pd.Series, total: pd.Series, tie: pd.Series) -> pd.Series:
        out = []
        for s, t, i in zip(scope, total, tie):
            starts, names = bounds[s]
            out.append(names[bisect_right(starts, _position(t, i)) - 1])
        return pd.Series(out, dtype="object")

    return piece


class _Pieces:
    """The pieces and cuts after a batch: one row per piece and three per scope."""

    def __init__(self, pieces: dict[str, list[dict]], cuts: dict[str, dict[str, list]]):
        self.pieces, self.cuts = pieces, cuts

    @classmethod
    def read(cls, spark: SparkSession, path: str | None) -> _Pieces:
        pieces, cuts = {}, {}
        for row in spark.read.text(path).collect() if path else []:
            e = json.loads(row.value)
            if "cuts" in e:
                cuts[e["scope"]] = e["cuts"]
            else:
                pieces.setdefault(e["scope"], []).append({**e, "start": tuple(e["start"])})
        for held in pieces.values():
            held.sort(key=lambda p: p["start"])
        return cls(pieces, cuts)

    def write(self, spark: SparkSession, path: str) -> None:
        lines = [(json.dumps(p),) for held in self.pieces.values() for p in held]
        lines += [(json.dumps({"scope": s, "cuts": c}),) for s, c in self.cuts.items()]
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(path)

    def bounds(self) -> dict[str, tuple[list[tuple], list[str]]]:
        return {s: ([p["start"] for p in held], [p["name"] for p in held]) for s, held in self.pieces.items()}

    def places(self) -> dict[str, dict[str, tuple[int, int]]]:
        """Per scope and tier: number of the piece in which the cut lies, and its row there (from 1)."""
        out = {}
        for scope, held in self.pieces.items():
            n = sum(p["n"] for p in held)
            if not n:
                continue
            s = max(1, math.ceil(n * K.TIER_SHARES["S"]))
            a = s + math.ceil(n * K.TIER_SHARES["A"])
            b = a + math.ceil(n * K.TIER_SHARES["B"])
            out[scope] = {}
            for tier, take in (("S", s), ("A", a), ("B", b)):
                left = min(take, n)
                for no, p in enumerate(held):
                    if left <= p["n"]:
                        break
                    left -= p["n"]
                out[scope][tier] = (no, left)
        return out

    def touched(self, places: dict[str, dict[str, tuple[int, int]]]) -> list[dict]:
        """Pieces that hold a cut now, or lie between its place before and now."""
        out = []
        for scope, held in self.pieces.items():
            starts, numbers = [p["start"] for p in held], set()
            for tier, (no, _) in places.get(scope, {}).items():
                old = self.cuts.get(scope, {}).get(tier)
                at = bisect_right(starts, tuple(old)) - 1 if old else no
                numbers.update(range(min(at, no), max(at, no) + 1))
            out += [held[i] for i in sorted(numbers)]
        return out


def _cut_table(spark: SparkSession, cuts: dict[str, dict[str, list]], prefix: str) -> DataFrame:
    """One row per scope; a cut is its (rank, -total, id)."""
    kind = "struct<rank:int,minus:double,tie:string>"
    rows = [(s, *[tuple(c[t]) if t in c else None for t in ("S", "A", "B")]) for s, c in cuts.items()]
    return spark.createDataFrame(rows, f"_scope string, {', '.join(f'{prefix}{t} {kind}' for t in ('S', 'A', 'B'))}")


def _tier(prefix: str) -> Column:
    place = F.struct(F.lit(1).alias("rank"), (-F.col("total")).alias("minus"), F.col("_tie").alias("tie"))
    within = {t: F.coalesce(F.col("total").isNotNull() & (place <= F.col(prefix + t)), F.lit(False)) for t in ("S", "A", "B")}
    return (
        F.when(F.col("total") < K.QUALITY_FLOOR, "rejected")
        .when(within["S"], "S")
        .when(within["A"], "A")
        .when(within["B"], "B")
        .otherwise("rejected")
    )


def retier_changes(
    scores: DataFrame,
    state_path: str,
    checkpoint: str,
    sink: Callable[[DataFrame, int], None],
    key: Sequence[str] = ("session_id", "image_id"),
    by: Sequence[str] = (),
    exceeds: str = "exceeds_face_limit",
    seq: str = "seq",
    piece_rows: int = PIECE_ROWS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Hand `sink` the tiers that a micro-batch sets or changes: (key..., total, tier), one row per asset.

    The newest row per asset of all that `sink` was given has the tiers of `assign_tiers` over all assets scored so
    far. A batch reads itself, the pieces in which a cut lies or moved, and one line per piece; nothing else of what
    is stored. `by` names scopes among the key columns (sessions or folders of a run, few enough for the driver).

    Ties go to the smaller image id. In a batch the row with the greatest `seq` counts, a later batch wins over an
    earlier one. Rows over the face limit keep the tier they carry, "rejected" if none, and do not count. NULL and
    NaN totals rank last and are rejected. Needs the RocksDB state store (`live.use_state_store`), which holds one
    total per asset; rows lie below `state_path`. A repeated batch replaces what it had written.
    """
    if not set(by) <= set(key):
        raise ValueError(f"scopes {list(by)} are not among the key {list(key)}")
    log, key, by = BatchLog(state_path, checkpoint), list(key), list(by)
    out = F.coalesce(F.col(exceeds), F.lit(False)) if exceeds in scores.columns else F.lit(False)
    had = F.col("tier").cast("string") if "tier" in scores.columns else F.lit(None).cast("string")
    total = F.col("total").cast("double")
    arriving = scores.select(
        *key,
        F.when(~F.isnan(total), total).alias("total"),
        F.coalesce(F.col(seq).cast("bigint"), F.lit(-(2**63))).alias("version"),
        (~out).alias("ranked"),
        had.alias("had"),
    )
    fields = [arriving.schema[c] for c in (*key, "total", "ranked", "had")]
    fields += [T.StructField("old_total", T.DoubleType()), T.StructField("old_ranked", T.BooleanType())]
    replaced = arriving.groupBy(*key).transformWithStateInPandas(
        statefulProcessor=_Replaced([f.name for f in fields]), outputStructType=T.StructType(fields), outputMode="Append", timeMode="None"
    )
    scope = F.to_json(F.struct(*by)) if by else F.lit("")
    order = [F.desc_nulls_last("total"), F.asc("_tie")]
    start = F.struct(F.when(F.col("total").isNull(), 2).otherwise(1).alias("rank"), F.coalesce(-F.col("total"), F.lit(0.0)).alias("minus"), F.col("_tie").alias("tie"))
    stored = T.StructType([arriving.schema[c] for c in key]).add("total", "double").add("_tie", "string").add("_scope", "string")
    stored = stored.add("_piece", "string").add("_sign", "integer").add("_since", "long")

    def live(spark: SparkSession, pieces: Sequence[dict]) -> DataFrame:
        paths = [p for piece in pieces for p in piece["paths"]]
        rows = spark.read.schema(stored).parquet(*paths) if paths else spark.createDataFrame([], stored)
        held = rows.groupBy(*key, "total", "_tie", "_scope", "_piece").agg(
            F.sum("_sign").alias("_n"), F.max(F.when(F.col("_sign") > 0, F.col("_since"))).alias("_since")
        )
        return held.where("_n > 0").drop("_n")

    def write_rows(rows: DataFrame, path: str) -> None:
        rows.withColumn("_dir", F.col("_piece")).select(*stored.names, "_dir").write.mode("overwrite").partitionBy("_dir").parquet(path)

    def add(state: _Pieces, rows: DataFrame, home: str, batch_id: int) -> None:
        """Put the signed rows of the batch into their pieces."""
        for (s,) in rows.select("_scope").distinct().collect():
            state.pieces.setdefault(s, [{"scope": s, "name": f"{batch_id}-{len(state.pieces)}", "start": START, "n": 0, "paths": []}])
        old = F.when(F.col("old_ranked"), F.struct(F.col("old_total").alias("total"), F.lit(-1).alias("_sign")))
        new = F.when(F.col("ranked"), F.struct(F.col("total").alias("total"), F.lit(1).alias("_sign")))
        signed = rows.select(*key, "_tie", "_scope", F.explode(F.array(old, new)).alias("_e")).where("_e IS NOT NULL")
        signed = signed.select(*key, "_tie", "_scope", "_e.*", F.lit(batch_id).cast("bigint").alias("_since"))
        placed = signed.withColumn("_piece", _piece_of(state.bounds())("_scope", "total", "_tie"))
        write_rows(placed.repartition("_piece"), f"{home}/rows")
        added = rows.sparkSession.read.schema(stored).option("recursiveFileLookup", True).parquet(f"{home}/rows")
        grown = {r._piece: r.n for r in added.groupBy("_piece").agg(F.sum("_sign").alias("n")).collect()}
        for held in state.pieces.values():
            for p in held:
                if p["name"] in grown:
                    p["n"] += grown[p["name"]]
                    p["paths"] = [*p["paths"], f"{home}/rows/_dir={p['name']}"]

    def split(spark: SparkSession, state: _Pieces, home: str, batch_id: int) -> None:
        """Write anew the pieces that are too large or lie in too many files."""
        worn = [p for held in state.pieces.values() for p in held if p["n"] > 2 * piece_rows or len(p["paths"]) > PIECE_FILES]
        if not worn:
            return
        parts = max(1, math.ceil(sum(p["n"] for p in worn) / piece_rows))
        ranged = live(spark, worn).repartitionByRange(parts, "_piece", *order)
        name = F.substring(F.md5(F.concat_ws("/", F.lit(str(batch_id)), "_piece", F.spark_partition_id().cast("string"))), 1, 16)
        kept = store(ranged.withColumn("_from", F.col("_piece")).withColumn("_piece", name).withColumn("_sign", F.lit(1)), "pieces")
        write_rows(kept, f"{home}/split")
        made: dict[str, list[dict]] = {}
        for r in kept.groupBy("_from", "_scope", "_piece").agg(F.count(F.lit(1)).alias("n"), F.min(start).alias("start")).collect():
            piece = {"scope": r._scope, "name": r._piece, "start": tuple(r.start), "n": r.n, "paths": [f"{home}/split/_dir={r._piece}"]}
            made.setdefault(r._from, []).append(piece)
        for p in worn:
            new = sorted(made.get(p["name"], []), key=lambda q: q["start"]) or [{**p, "paths": []}]
            new[0]["start"] = p["start"]
            held = state.pieces[p["scope"]]
            at = held.index(p)
            held[at : at + 1] = new

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, home = batch.sparkSession, log.folder(batch.sparkSession, batch_id)
        state = _Pieces.read(spark, f"{log.folder(spark, batch_id - 1)}/state" if batch_id else None)
        tie = F.coalesce(F.col("image_id").cast("string"), F.lit(""))
        rows = store(batch.withColumn("_tie", tie).withColumn("_scope", scope), "retier-batch")
        add(state, rows, home, batch_id)
        split(spark, state, home, batch_id)

        places = state.places()
        near = store(live(spark, state.touched(places)), "near-cuts")
        wanted = [(s, t, state.pieces[s][no]["name"], row) for s, at in places.items() for t, (no, row) in at.items()]
        wanted = spark.createDataFrame(wanted, "scope string, tier string, _piece string, _row int")
        numbered = near.withColumn("_row", F.row_number().over(Window.partitionBy("_piece").orderBy(*order)))
        cuts: dict[str, dict[str, list]] = {s: {} for s in state.pieces}
        for r in numbered.join(wanted, ["_piece", "_row"]).select("scope", "tier", start.alias("at")).collect():
            cuts[r.scope][r.tier] = list(r.at)

        now, before = _cut_table(spark, cuts, "now"), _cut_table(spark, state.cuts, "old")
        own = F.when(F.col("ranked"), _tier("now")).otherwise(F.coalesce("had", F.lit("rejected")))
        arrived = rows.join(now, "_scope", "left").select(*key, "total", own.alias("tier"))
        others = near.where(F.col("_since") < batch_id).join(now, "_scope").join(before, "_scope")
        moved = others.where(_tier("now") != _tier("old")).select(*key, "total", _tier("now").alias("tier"))
        sink(store(arrived.unionByName(moved), "tier-changes"), batch_id)
        # Last, so that a state is only there for a batch that was handed on.
        _Pieces(state.pieces, cuts).write(spark, f"{home}/state")

    return (
        replaced.writeStream.foreachBatch(each)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

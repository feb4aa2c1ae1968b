"""Messages delivered more than once: exactly one copy of each is kept.

Identifiers are dictionary-encoded exactly (the dictionary holds the strings; a code is a shard and
a dense rank in it). What was seen is a set of bitmaps, one for each (shard, 32,768 ranks), stored
zstd-compressed. Arrivals are taken batch by batch: whose bit is set was seen; of the others one
arrival is selected for each message, and the new bits are united with the old. A version of the
ledger adds what is new to those before it, and one rename makes it current.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwright.operators.components import connected_components
from siftwright.session import new_path, stage

RANK_BITS = 40
BITMAP_BITS = 32768
#: Versions whose additions are read together; the next one is written whole.
COMPACT = 16
#: Shards of a ledger, and the identifiers that one more is made for.
LEAST_SHARDS, A_SHARD = 256, 1_000_000


def message_key(col: Column) -> Column:
    """A message identifier without what does not matter; null where it identifies nothing.

    White space and angle brackets around it go, and the case of what follows the last ``@``.
    """
    bare = F.regexp_replace(col, r"(?U)^[\s<]+|[\s>]+$", "")
    local = F.regexp_extract(bare, r"(?s)^(.*)@[^@]*$", 1)
    host = F.lower(F.substring_index(bare, "@", -1))
    return F.when(F.contains(bare, F.lit("@")), F.concat(local, F.lit("@"), host))


def digest_key(col: Column) -> Column:
    """A hexadecimal digest in lower case; null where empty."""
    return F.nullif(F.lower(F.trim(col)), F.lit(""))


class DeliveryLedger:
    """Dictionary, links and seen-bitmaps of one stream of deliveries, in numbered versions.

    ``shards`` is fixed when the ledger is made; it bounds the keys that are ranked together.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 256):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version; 0 where nothing was committed."""
        if not self._fs.exists(self._path(self.path)):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return max((int(n[7:]) for n in names if n.startswith("commit-")), default=0)

    def _state(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders that a version's tables are in, the oldest first: its marker says so."""
        v = self.version() if version is None else version
        if not v:
            return {"dictionary": [], "seen": []}
        f = self._fs.open(self._path(f"{self.path}/commit-{v}"))
        try:
            return json.loads(f.readUTF())
        finally:
            f.close()

    def _read(self, name: str, schema: str) -> list[DataFrame]:
        folders = self._state()[name]
        return [self.spark.read.schema(schema).parquet(f"{self.path}/{f}/{name}") for f in folders] or [self.spark.createDataFrame([], schema)]

    def dictionary(self) -> DataFrame:
        """(key, code, label): each identifier's code, and that of its message; the latest version's label holds."""
        parts = self._read("dictionary", "key string, code long, label long")
        if len(parts) == 1:
            return parts[0]
        every = reduce(DataFrame.unionByName, [p.withColumn("_v", F.lit(i)) for i, p in enumerate(parts)])
        return every.groupBy("key", "code").agg(F.max_by("label", "_v").alias("label"))

    def seen(self) -> DataFrame:
        parts = self._read("seen", "bucket long, bits binary")
        return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def commit(self, dictionary: DataFrame | None, seen: DataFrame, base: int | None = None) -> None:
        """Write what a version adds in a folder of its own, then make it current by one rename.

        ``dictionary`` are new or changed rows, or null for none; ``seen`` are bitmaps to unite. ``base`` is the version that they
        were made from; if another writer committed since, the rename finds its marker in the way,
        and nothing of either is lost. Every ``COMPACT`` versions all is written anew as one.
        """
        base = self.version() if base is None else base
        v, folder, state = base + 1, f"data-{base + 1}-{uuid.uuid4().hex[:12]}", self._state(base)
        if len(state["seen"]) >= COMPACT:
            seen = self.seen().unionByName(seen).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
            old = self.dictionary()
            dictionary = old if dictionary is None else old.join(dictionary.select("key"), "key", "left_anti").unionByName(dictionary)
            state = {"dictionary": [], "seen": []}
        if dictionary is not None:
            dictionary.write.option("compression", "zstd").parquet(f"{self.path}/{folder}/dictionary")
            state["dictionary"].append(folder)
        seen.write.option("compression", "zstd").parquet(f"{self.path}/{folder}/seen")
        state["seen"].append(folder)
        fresh = self._path(f"{self.path}/.marker-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.writeUTF(json.dumps(state))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else self._fs.getUri())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fresh, self._path(f"{self.path}/commit-{v}"), plain)
        except Exception as e:
            self._fs.delete(fresh, False)
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            raise RuntimeError(f"version {v} was committed by another writer") from e


def _bucket(code: Column) -> Column:
    return F.floor(code / F.lit(BITMAP_BITS)).cast("long")


def _bit(code: Column) -> Column:
    return F.pmod(code, F.lit(BITMAP_BITS)).cast("long")


def _is_set(bits: Column, pos: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, F.pmod(pos, F.lit(8)).cast("int")) == 1, F.lit(False))


def _learned(batch: DataFrame, id_col: str, identifiers: list[Column], order: list[Column], ledger: DeliveryLedger) -> tuple[DataFrame, DataFrame]:
    """(arrivals (_id, _rank, _label, _codes), what the dictionary gains) of a batch: codes of its identifiers, and which are of one message."""
    key_cols = [f"_k{i}" for i in range(len(identifiers))]
    rank = F.struct(*[x for i, o in enumerate(order) for x in (o.isNull().alias(f"n{i}"), o.alias(f"o{i}"))], F.col(id_col).alias("i"))
    rows = batch.select(F.col(id_col).alias("_id"), rank.alias("_rank"), *[F.concat(F.lit(f"{i}:"), c).alias(k) for i, (k, c) in enumerate(zip(key_cols, identifiers, strict=True))]).filter("_id is not null").dropDuplicates(["_id"])

    keys = rows.select(F.explode(F.array(*key_cols)).alias("key")).filter("key is not null").distinct()
    old = ledger.dictionary()
    shard = F.pmod(F.xxhash64("key"), F.lit(ledger.shards))
    base = old.groupBy(F.shiftright("code", RANK_BITS).alias("shard")).agg((F.max(F.col("code").bitwiseAND(F.lit((1 << RANK_BITS) - 1))) + 1).alias("base"))
    w = Window.partitionBy("shard").orderBy("key")
    coded = (
        keys.join(old, "key", "left_anti").withColumn("shard", shard).withColumn("r", F.row_number().over(w) - 1)
        .join(base, "shard", "left")
        .select("key", (F.shiftleft(F.col("shard").cast("long"), RANK_BITS) + F.coalesce("base", F.lit(0)) + F.col("r")).alias("code"))
    )
    fresh = stage(coded.withColumn("label", F.col("code")), "fresh")
    touched = fresh.unionByName(old.join(keys, "key", "left_semi").select("key", "code", "label"))

    wide = rows.select("_id", "_rank", *key_cols)
    for k in key_cols:
        wide = wide.join(touched.select(F.col("key").alias(k), F.col("label").alias(f"{k}_l"), F.col("code").alias(f"{k}_c")), k, "left").drop(k)
    labels, codes = [f"{k}_l" for k in key_cols], [f"{k}_c" for k in key_cols]
    wide = stage(wide.withColumn("_label", F.coalesce(*labels)), "arrivals")

    # Identifiers that occur with one partner only hang on it; the others make the edges.
    edges = None
    for lb in labels[1:]:
        pairs = wide.select(F.col("_label").alias("a"), F.col(lb).alias("b")).filter("a is not null and b is not null and a <> b").distinct()
        edges = pairs if edges is None else edges.unionByName(pairs)
    if edges is None:
        edges = wide.select(F.col("_label").alias("a"), F.col("_label").alias("b")).limit(0)
    hub = edges.groupBy("b").agg(F.min("a").alias("hub"), F.count("*").alias("n"))
    firsts = edges.select(F.col("a").alias("b")).distinct()
    leaf = stage(hub.filter("n = 1").join(firsts, "b", "left_anti").select("b", "hub"), "leaves")
    rest = edges.join(leaf.select("b"), "b", "left_anti").join(hub.select("b", "hub"), "b")
    linked = connected_components(rest.select(F.col("a"), F.col("hub").alias("b")).unionByName(rest.select(F.col("b").alias("a"), F.col("hub").alias("b"))))
    moved = stage(
        linked.select(F.col("node").alias("label"), F.col("component").alias("to"))
        .unionByName(leaf.join(linked, leaf.hub == linked.node, "left").select(F.col("b").alias("label"), F.coalesce("component", "hub").alias("to"))),
        "moved",
    )
    arrivals = wide.join(moved.withColumnRenamed("label", "_label"), "_label", "left").select("_id", "_rank", F.coalesce("to", "_label").alias("_label"), F.array_compact(F.array(*codes)).alias("_codes"))
    again = old.join(moved.filter("label <> to"), "label").select("key", "code", F.col("to").alias("label"))
    new = fresh.join(moved, "label", "left").select("key", "code", F.coalesce("to", "label").alias("label"))
    return stage(arrivals, "labelled"), new.unionByName(again)


def _taken(arrivals: DataFrame, id_col: str, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, redelivery) of each arrival, bitmaps of what is seen now): of a message none of whose bits is set, the least arrival is selected."""
    known_by = arrivals.filter("_label is not null").select("_label", F.explode(F.array_union(F.array("_label"), "_codes")).alias("code")).distinct()
    bucket = _bucket(F.col("code"))
    probed = known_by.withColumn("bucket", bucket).join(seen, "bucket", "left").filter(_is_set(F.col("bits"), _bit(F.col("code")))).select("_label").distinct()
    unseen = arrivals.filter("_label is not null").join(probed, "_label", "left_anti")
    chosen = unseen.groupBy("_label").agg(F.min("_rank").alias("r")).select(F.col("r.i").alias("_id"))
    kept = chosen.unionByName(arrivals.filter("_label is null").select("_id")).withColumn("_kept", F.lit(True))
    result = stage(arrivals.select("_id").join(kept, "_id", "left").select(F.col("_id").alias(id_col), F.col("_kept").isNull().alias("redelivery")), "delivered")
    return result, known_by.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(_bit(F.col("code"))).alias("bits"))


def ingest(batch: DataFrame, id_col: str, identifiers: list[Column], order: list[Column], ledger: DeliveryLedger) -> DataFrame:
    """Take a batch into the ledger; (id, redelivery BOOLEAN) for each of its rows.

    Two rows are of one message if they share an identifier, directly or through other rows, of
    this batch or of earlier ones. Of a message not seen before, the row least by ``order`` and
    then id is kept; all others are redeliveries. Null identifiers identify nothing: a row without
    any is its own message. Nulls in ``order`` come last. Ids must be unique in the batch; rows
    repeated whole under one id count once, and rows without an id are left out. An empty batch gives an empty result. Hot messages are
    reduced before shuffles (least row by partial aggregation, distinct identifier pairs), and what
    remains is joined on the unique id. The ledger is committed before the result is returned.
    """
    version = ledger.version()
    arrivals, gained = _learned(batch, id_col, identifiers, order, ledger)
    result, bits = _taken(arrivals, id_col, ledger.seen())
    ledger.commit(gained, bits, version)
    return result


def redeliveries(batch: DataFrame, id_col: str, identifiers: list[Column], order: list[Column], shards: int | None = None, slices: int = 2) -> DataFrame:
    """The ids of all rows but the first of each message, over one whole table and a ledger of its own.

    What belongs together is learnt of the whole table first; then the arrivals are taken in
    ``slices`` of their first order column, if that is a number or a time, the earliest first, each
    against the bits that those before it have set. The result is the same for any number.
    """
    spark = batch.sparkSession
    ledger = DeliveryLedger(spark, new_path(spark, "ledger"), shards or max(LEAST_SHARDS, batch.count() * len(identifiers) // A_SHARD))
    arrivals, gained = _learned(batch, id_col, identifiers, order, ledger)
    parts = [arrivals]
    if order and slices > 1:
        first, kind = F.col("_rank.o0"), arrivals.schema["_rank"].dataType["o0"].dataType
        value = first.cast("double") if isinstance(kind, T.NumericType) else F.unix_micros(first.cast("timestamp")) if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType) else None
        at = (arrivals.agg(F.percentile_approx(value, [k / slices for k in range(1, slices)])).first()[0] or []) if value is not None else []
        # Ties stay together; nulls come last.
        number = F.coalesce(sum(((value > x).cast("int") for x in at), F.lit(0)), F.lit(len(at)))
        parts = [arrivals.filter(number == k) for k in range(len(at) + 1)]
    out = []
    for k, part in enumerate(parts):
        result, bits = _taken(part, id_col, ledger.seen())
        ledger.commit(gained if k == 0 else None, bits, k)
        out.append(result.filter("redelivery").select(id_col))
    return reduce(DataFrame.unionByName, out)

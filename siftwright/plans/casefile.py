"""A case: a folder of tables on shared storage that intake, analysis and searches work on."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.engine import Engine, Options
from siftwright.plans import case, indicators, score
from siftwright.session import stage

_EVIDENCE = "sha256 string, path string, content binary, msg_format string, added string"


@dataclass
class Case:
    """Evidence, index, indicators and the custody log of a case; acts are logged with their examiner."""

    spark: SparkSession
    folder: str
    examiner: str

    def _table(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    @property
    def evidence(self) -> DataFrame:
        return self._table("evidence", _EVIDENCE)

    @property
    def index(self) -> DataFrame:
        return self._table("index", "report_id string, sha256 string, subject string, from_address string, verdict string, score int")

    @property
    def indicators(self) -> DataFrame:
        return self._table("indicators", "report_id string, seq int, type string, value string, role string, context string, verdict string, evidence_sha256 string")

    @property
    def log(self) -> DataFrame:
        return self._table("custody", case.LOG)

    def _log(self, action: str, details: dict) -> None:
        last = self.log.orderBy(F.desc("seq")).select("seq", "hash").first()
        now = datetime.now(timezone.utc).isoformat()
        (row,) = case.append_entries([{"time": now, "action": action, "examiner": self.examiner, "details": details}], last.hash if last else case.GENESIS, (last.seq if last else 0) + 1)
        self.spark.createDataFrame([tuple(row[c.split(" ")[0]] for c in case.LOG.split(", "))], case.LOG).write.mode("append").parquet(f"{self.folder}/custody")

    def init(self) -> None:
        """Begin the custody log; a case that has one is left as it is."""
        if not self.log.limit(1).count():
            self._log("init", {})

    def add(self, files: DataFrame) -> int:
        """Take in ``files(path, content[, msg_format])`` that the case doesn't have, each content once; how many these were."""
        given = files if "msg_format" in files.columns else files.withColumn("msg_format", F.lit("eml"))
        rows = given.select(F.sha2("content", 256).alias("sha256"), "path", "content", "msg_format", F.lit(datetime.now(timezone.utc).isoformat()).alias("added"))
        new = stage(case.only_new(rows, self.evidence).select("sha256", "path", "content", "msg_format", "added"), "intake")
        n = new.count()
        if n:
            new.write.mode("append").parquet(f"{self.folder}/evidence")
            digest = set_digest(new)
            self._log("add", {"files": n, "digest": digest})
        return n

    def analyze(self, options: Options | None = None) -> int:
        """Analyse the evidence that isn't in the index; how many reports that gave."""
        todo = self.evidence.join(self.index.select("sha256").distinct(), "sha256", "left_anti")
        empty = F.lit(None).cast("string")
        e = Engine(self.spark, todo.select("path", "content", "msg_format", empty.alias("container"), empty.alias("container_sha256")), options or Options())
        rows = stage(e.tables.messages.join(e.assessments.select("report_id", "verdict", "score"), "report_id").select("report_id", "sha256", "subject", "from_address", "verdict", "score"), "index")
        found = stage(e.indicators.select("report_id", "seq", "type", "value", "role", "context", "verdict", "evidence_sha256"), "indicators")
        n = rows.count()
        if n:
            found.write.mode("append").parquet(f"{self.folder}/indicators")
            rows.write.mode("append").parquet(f"{self.folder}/index")
            self._log("analyze", {"reports": n})
        return n

    def search(self, query: str, kind: str | None = None) -> DataFrame:
        return indicators.search(self.indicators, self.index, query, kind)

    def shared(self, least: int = 2) -> DataFrame:
        return indicators.shared(self.indicators, least)

    def tally(self) -> DataFrame:
        """(verdict, reports): how many reports came to each verdict."""
        return score.tally(self.index).filter("verdict is not null and tens is null").select("verdict", "reports")

    def report(self, folder: str) -> None:
        """Write the case's page, its indicators as CSV and its index, worst first, to a folder."""
        from siftwright.plans import report, sinks

        rows = self.index.withColumn("line", F.concat_ws(" ", F.col("score").cast("string"), "verdict", "from_address", "subject"))
        sinks.csv_rows(self.indicators).write.mode("overwrite").option("header", True).csv(f"{folder}/iocs")
        rows.drop("line").orderBy(F.desc("score"), "report_id").write.mode("overwrite").option("header", True).csv(f"{folder}/index")
        report.case_page(self.tally(), rows, self.shared(), self.log).write.mode("overwrite").text(f"{folder}/page")
        self._log("report", {"folder": folder})

    def worst(self) -> DataFrame:
        return self.index.orderBy(F.desc(F.coalesce("score", F.lit(0))), "report_id")

    def verify(self) -> DataFrame:
        """(kind, detail) of what isn't as it was: log entries, and evidence whose bytes changed."""
        custody = case.verify_log(self.log).select(F.lit("custody").alias("kind"), F.concat_ws(" ", F.col("seq").cast("string"), "problem").alias("detail"))
        altered = self.evidence.filter(F.sha2("content", 256) != F.col("sha256")).select(F.lit("evidence").alias("kind"), F.col("path").alias("detail"))
        logged = self.log.filter("action = 'add'").agg(F.coalesce(F.sum(F.get_json_object("details", "$.files").cast("long")), F.lit(0)).alias("logged"))
        held = self.evidence.agg(F.count("*").alias("held"))
        count = logged.join(held, F.col("logged") != F.col("held")).select(F.lit("evidence").alias("kind"), F.lit("count differs from the log").alias("detail"))
        return custody.unionByName(altered).unionByName(count)


def set_digest(files: DataFrame) -> str:
    """A digest of ``files(sha256)`` as a multiset, whatever their order and number: sums of the digests' quarters, each modulo 2 ** 64.

    Partial sums meet in one row, so no task has more than that of the digests.
    """
    quarters = [F.sum(F.conv(F.substring("sha256", 1 + 16 * i, 16), 16, 10).cast("decimal(28,0)")).alias(f"q{i}") for i in range(4)]
    row = files.agg(F.count("*").alias("n"), *quarters).first()
    return f"{row.n}:" + "".join(f"{int(row[f'q{i}'] or 0) % 2**64:016x}" for i in range(4))


def as_bad_as(index: DataFrame, verdict: str) -> DataFrame:
    """The index rows of a verdict or a worse one."""
    least = next(s for s, v in score.VERDICTS if v == verdict)
    return index.filter(F.col("score") >= least)

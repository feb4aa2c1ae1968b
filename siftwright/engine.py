"""The engine: files to findings, scores, indicators and outputs in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions import urls as ur
from siftwright.functions.filetype import EXECUTABLE
from siftwright.functions.domains import org_domain
from siftwright.operators import archives, imitation, mailauth, payloads, signatures
from siftwright.plans import detect, detect_files, enrich, indicators, names, rules, score, sinks
from siftwright.session import stage
from siftwright.sources import mbox, outlook, parse


@dataclass(frozen=True)
class Options:
    """What an analysis takes besides the evidence.

    ``dns(name, type, answers, error)`` are recorded DNS answers, ``answers(provider, request, response, error)`` those of reputation
    services, ``signatures`` the text of content signatures; ``now``, in seconds since 1970, is when signatures expire.
    """

    protected: tuple[str, ...] = ()
    timeout: float | None = None
    rules: tuple[rules.Rule, ...] = ()
    min_severity: str = "info"
    nesting: int = parse.NESTING
    dns: DataFrame | None = None
    spf_ip: str | None = None
    answers: DataFrame | None = None
    signatures: str | None = None
    now: float | None = None


@dataclass
class Engine:
    """Tables of one analysis. Each is a plan over the staged parse, made when it is asked for."""

    spark: SparkSession
    evidence: DataFrame
    options: Options = field(default_factory=Options)

    @classmethod
    def of_folder(cls, spark: SparkSession, path: str, options: Options | None = None) -> Engine:
        """Message files of a folder: internet messages, Outlook files, and mailboxes message by message."""
        files = parse.read_files(spark, path)
        none = F.lit(None).cast("string")
        absent = {"container": none, "container_sha256": none, "modified_by": none, "unread": none}
        eml = files.filter("msg_format = 'eml'").select("path", "content", "msg_format").withColumns(absent)
        msg = outlook.converted(files.filter("msg_format = 'msg'")).withColumns(absent | {"modified_by": F.col("modified_by"), "unread": F.col("error")})
        large = parse.large_files(spark, path)
        left = large.filter("not is_box").withColumns({"content": F.lit(None).cast("binary"), "msg_format": F.lit("eml")} | absent | {"unread": F.concat(F.lit("too large: "), F.col("length").cast("string"), F.lit(" bytes"))})
        every = [eml, msg.select(*eml.columns), left.select(*eml.columns)]
        boxes = [r.path for r in files.filter("msg_format = 'mbox'").select("path").unionByName(large.filter("is_box").select("path")).collect()]
        if boxes:
            every.append(mbox.messages(spark, boxes).withColumns({"modified_by": none, "unread": none}).select(*eml.columns))
        return cls(spark, reduce(DataFrame.unionByName, every), options or Options())

    @cached_property
    def tables(self) -> parse.Evidence:
        return parse.Evidence(stage(parse.parsed(self.evidence, self.options.timeout, self.options.nesting, self.options.now), "parsed"))

    @cached_property
    def facts(self) -> DataFrame:
        return stage(payloads.facts(self.tables.attachments), "facts")

    @cached_property
    def scripts(self) -> DataFrame:
        """(report_id, part, text) of attached scripts."""
        return self.tables.attachments.filter(F.col("extension").isin(*sorted(EXECUTABLE)) & (F.col("detected_type").isNull() | (F.col("detected_type") == "script"))).select("report_id", "part", F.decode("payload", "ISO-8859-1").alias("text"))

    @cached_property
    def urls(self) -> DataFrame:
        """All URLs of bodies, attached pages, documents, shortcuts and scripts; the many of one part take no place from another's."""
        return ur.collect_urls(self.tables.links.unionByName(payloads.links(self.facts, self.scripts)), 2**31 - 1)

    @cached_property
    def members(self) -> DataFrame:
        return archives.members(self.tables.attachments)

    @cached_property
    def authentication(self) -> dict[str, DataFrame | None]:
        """``dkim``, ``arc``, ``spf`` and ``dmarc`` results; without recorded DNS answers signatures stay open, and the last two are null."""
        t, o = self.tables, self.options
        dkim, arc = stage(mailauth.dkim_settled(t.rows, o.dns), "dkim"), mailauth.arc_settled(t.rows, o.dns)
        if o.dns is None:
            return {"dkim": dkim, "arc": arc, "spf": None, "dmarc": None}
        inputs = mailauth.spf_inputs(t.messages, t.headers, t.hops, t.auth_results, o.spf_ip)
        spf = stage(mailauth.spf(inputs, o.dns), "spf")
        return {"dkim": dkim, "arc": arc, "spf": spf, "dmarc": stage(mailauth.dmarc(t.messages, dkim, spf, o.dns), "dmarc")}

    @cached_property
    def extracted(self) -> DataFrame:
        """Indicators, before anything is judged."""
        t = self.tables
        return stage(indicators.extract(t.messages, t.hops, self.urls, t.attachments, self.members), "indicators")

    def _of_senders(self) -> list[DataFrame]:
        """Findings of signatures, chains, senders and policies, and of what the receiver recorded otherwise."""
        r, m = self.authentication, self.tables.messages.filter("header_count is not null")
        rebuilt = m.filter("msg_format in ('msg', 'attached')").select("report_id")
        out = [mailauth.findings(m, r["dkim"], r["arc"], r["spf"], r["dmarc"], self.options.dns is not None, rebuilt)]
        if r["spf"] is not None:
            sent = self.tables.auth_results.join(rebuilt, "report_id", "left_anti")
            out.append(mailauth.mismatches(sent, r["dkim"], r["spf"], r["dmarc"]))
        return out

    def _of_services(self) -> list[DataFrame]:
        """Findings of reputation services' recorded answers, and of content signatures."""
        out, o, t = [], self.options, self.tables
        if o.answers is not None or o.dns is not None:
            asked = indicators.report_targets(self.extracted, org_domain(self.spark))
            said = [enrich.recorded_answers(asked, o.answers)] if o.answers is not None else []
            said += [enrich.routed_answers(asked, o.dns)] if o.dns is not None else []
            out.append(enrich.findings(asked, enrich.summaries(reduce(DataFrame.unionByName, said)), t.messages))
        if o.signatures is not None:
            found = stage(signatures.scan(self.signature_targets, o.signatures), "signatures")
            out += [signatures.findings(found), signatures.unscanned(self.signature_targets)]
        return out

    @property
    def signature_targets(self) -> DataFrame:
        """(report_id, part, data): whole messages, bodies, attachments and macros."""
        name = F.concat(F.sha2("content", 256), F.lit("-"), F.substring(F.sha2(F.encode("path", "UTF-8"), 256), 1, 8))
        raw = self.evidence.filter("content is not null").select(name.alias("report_id"), F.lit("message").alias("part"), F.col("content").alias("data"))
        bodies = self.tables.bodies.select("report_id", F.concat(F.lit("body "), "mime_part").alias("part"), F.encode("preview", "UTF-8").alias("data"))
        return raw.unionByName(bodies).unionByName(self.tables.attachments.select("report_id", "part", F.col("payload").alias("data"))).filter("data is not null")

    @cached_property
    def detected(self) -> DataFrame:
        """Findings before rules, each with its place in the report."""
        t, spark = self.tables, self.spark
        # What couldn't be read has no headers that could be missing.
        m = t.messages.filter("header_count is not null")
        protected = names.brand_domains(spark)
        own = spark.createDataFrame([(d,) for d in self.options.protected], "domain string") if self.options.protected else None
        if own is not None:
            mine = own.withColumn("kind", F.lit("org"))
            protected = protected.join(mine, "domain", "left_anti").unionByName(mine)
        sent = m.select("report_id", F.explode(F.array_compact(F.concat(F.array("from_address", "return_path", "sender"), F.coalesce("reply_to", F.array().cast("array<string>"))))).alias("a"))
        hosts = sent.select("report_id", F.lower(F.substring_index("a", "@", -1)).alias("host"), F.lit("From").alias("location")).unionByName(self.urls.filter("host is not null").select("report_id", "host", F.lit("URL").alias("location"))).distinct()
        like = hosts.join(imitation.imitations(hosts.select("host"), protected), "host").select("report_id", "code", "severity", "location", F.to_json(F.struct("host", "imitates")).alias("evidence")).dropDuplicates(["report_id", "code", "location", "evidence"])
        in_bodies = t.links.join(t.attachments.select("report_id", "part"), ["report_id", "part"], "left_anti")
        errors = detect.findings_of(t.messages, detect.hit(F.col("error") == "ANALYSIS_TIMEOUT", "ANALYSIS_TIMEOUT", "medium"), detect.hit(F.col("error") != "ANALYSIS_TIMEOUT", "ANALYZER_ERROR", "low", None, error=F.col("error")), detect.hit(F.col("msg_format") == "msg", "MSG_SOURCE", "info"), detect.hit(F.coalesce("modified_by", F.lit("")) != "", "MSG_LAST_MODIFIED_BY", "info", None, modified_by=F.col("modified_by")))
        every = detect.union([
            detect.header_structure(m, t.headers), detect.sender_identity(m), detect.timeline(m, t.hops), detect.authentication(m, t.auth_results), detect.sending_software(m), detect.provider_path(m, t.hops), detect.provider_verdicts(m), names.impersonation(m, own), detect.limits(m), detect.structure(m, t.parts, t.bodies),
            detect.links(self.urls, in_bodies), detect.body(t.bodies), detect_files.pages(t.pages), detect_files.attachments(t.attachments), detect_files.archives(archives.archives(self.members, t.attachments), t.bodies), detect_files.script_files(self.scripts),
            payloads.findings(self.facts, t.attachments), like, errors, *self._of_senders(), *self._of_services(),
        ])
        every = stage(every.distinct(), "findings")
        return every.unionByName(detect.nested(t.messages, every).select(*every.columns))

    @cached_property
    def findings(self) -> DataFrame:
        """Findings in order of their place, after rules and suppression."""
        found = self.detected
        if self.options.rules:
            base = score.assess(self.tables.messages, score.placed(found))
            grouped = found.groupBy("report_id").agg(F.collect_list(F.struct("code", "severity")).alias("findings"))
            one = self.tables.messages.join(grouped, "report_id", "left").join(base.select("report_id", "score", "verdict"), "report_id", "left").withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<code:string,severity:string>>")))
            fields = rules.message_fields() | {"score": F.array(F.col("score").cast("string")), "verdict": F.array("verdict"), "findings": F.transform("findings", lambda f: f["code"])}
            done = rules.apply_rules(one, list(self.options.rules), fields)
            gone = done.select("report_id", F.explode("suppressed.code").alias("code")).distinct()
            severities = F.create_map(*[F.lit(x) for r in self.options.rules for x in (f"RULE_{r.id}", r.severity)])
            new = done.select("report_id", F.explode("matched").alias("code")).withColumn("severity", F.try_element_at(severities, F.col("code"))).withColumn("location", F.lit(None).cast("string")).withColumn("evidence", F.lit(None).cast("string"))
            found = found.join(gone, ["report_id", "code"], "left_anti").select(*detect.COLUMNS).unionByName(new.select(*detect.COLUMNS))
        return score.placed(found)

    @cached_property
    def assessments(self) -> DataFrame:
        return score.assess_nested(self.tables.messages, self.findings)

    @property
    def shown(self) -> DataFrame:
        """The findings of at least the least severity asked for; scores count all."""
        return self.findings.filter(score.severity_rank(F.col("severity")) >= score.SEVERITIES.index(self.options.min_severity))

    @property
    def indicators(self) -> DataFrame:
        return self.extracted.join(self.assessments.select("report_id", "verdict"), "report_id").join(self.tables.messages.select("report_id", F.col("sha256").alias("evidence_sha256")), "report_id")

    @property
    def reasons(self) -> DataFrame:
        f = self.findings.withColumn("category", score.category_of(F.col("code"), F.col("location")))
        return score.reasons(score.ranked_points(f, ["seq"]), ["seq"])

    def events(self, analyzed_at: str) -> DataFrame:
        return sinks.events(self.tables.messages, self.assessments, self.findings, self.reasons, analyzed_at)

    def fails(self, verdict: str) -> bool:
        """Whether any report is at least as bad as a verdict."""
        least = next(s for s, v in score.VERDICTS if v == verdict)
        return self.assessments.filter(F.col("score") >= least).limit(1).count() > 0

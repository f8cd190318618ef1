"""Secret scanning over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content; a ledger holds, for each blob and
rule version, the spans found. A scan leaves out the digests whose pair with the rule version the ledger has, deduplicates
what is left to blobs (comparing whole contents), scans each once, writes the entries to the ledger's folder, reads them back and joins
findings to all paths. So a blob that stands at a third of all paths is scanned once, and a second run over the same
folder scans new blobs only; on the way back a hot blob is a skewed left side of an outer join, which AQE splits, and only blobs with findings are looked up.

A rule is a pattern in the dialect that Java and others share, a shortest length, and the group that this length
holds for. Matches are leftmost and non-overlapping per rule, counted in code points, ends exclusive; where a match stands
follows from the lengths of the gaps that split() leaves between matches, so nothing leaves the JVM.

Defined results: null is the empty content; an empty table gives no rows; equal paths with other versions are separate rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, whole_text


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    shortest: int = 0
    #: A cheap necessary condition: one of these literals has to stand in the lower-cased content.
    needs: tuple[str, ...] = ()


#: The base rules, in the order in which spans with one start are listed.
BASE_RULES = (
    Rule(
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    # a match of [0-9a-f]+ is a maximal run, so asking for 24 in the pattern drops the same matches
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What the method adds.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyj",)),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", needs=("aiza",)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs=("-----begin ",)),
    Rule("userinfo", r"[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]+@", needs=("://",)),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "1"
SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"
SPANS = f"array<{SPAN}>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"


def spans_of(content: Column, lowered: Column, rule: Rule, rank: int) -> Column:
    """All spans of a rule in a content, by start."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(content, pattern, F.lit(0))
    checked = F.regexp_extract_all(content, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split(content, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("whole"), checked.alias("part"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["whole"])
        span = F.struct(begin.cast("long").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.cast("long").alias("end"))
        longer = F.when(F.char_length(x["part"]) >= rule.shortest, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.cast("long").alias("at"), longer.alias("spans"))

    named = F.transform(pairs, lambda x: F.struct(x["gap"].alias("gap"), x["whole"].alias("whole"), x["part"].alias("part")))
    spans = F.aggregate(named, start, step, lambda state: state["spans"])
    # contains() reads a text many times faster than a pattern does: nearly all texts end here
    likely = F.lit(False) if rule.needs else content.rlike(rule.pattern)
    for word in rule.needs:
        likely = likely | lowered.contains(word)
    return F.when(likely, spans).otherwise(F.array().cast(SPANS))


def scan(contents: DataFrame, content_col: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The table with ``spans``: array of (start, rank, kind, end), by start and then by the rules' order."""
    lowered = contents.withColumn("_lower", F.lower(content_col))
    each = [spans_of(F.col(content_col), F.col("_lower"), rule, i) for i, rule in enumerate(rules)]
    return lowered.withColumn("spans", F.array_sort(F.concat(*each))).drop("_lower")


def unseen_blobs(versions: DataFrame, content_col: str, ledger: DataFrame | None, rule_version: str) -> DataFrame:
    """Distinct contents (blob, content) whose pair with the rule version the ledger doesn't have. Digests meet the ledger before any content moves."""
    content = whole_text(content_col)
    blobs = versions.select(content.alias("content")).select(F.sha2("content", 256).alias("blob"), "content")
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob")
        unseen = blobs.select("blob").distinct().join(seen, "blob", "left_anti")
        blobs = blobs.join(unseen, "blob", "left_semi")
    return blobs.groupBy("blob", "content").agg(F.count(F.lit(1)).alias("_n")).drop("_n")


def ledger_entries(versions: DataFrame, content_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """What a scan adds to the ledger: blob, rule_version, spans (perhaps none), one row per blob scanned."""
    found = scan(unseen_blobs(versions, content_col, ledger, rule_version), "content", rules)
    return found.select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def findings_by_path(versions: DataFrame, ledger: DataFrame, id_col: str = "doc_id", content_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """One row per version of a path: id, blob, spans. Only blobs with findings are looked up."""
    paths = versions.select(F.col(id_col), F.sha2(whole_text(content_col), 256).alias("blob"))
    hits = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
    return paths.join(hits, "blob", "left").select(id_col, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger in a folder; empty where nothing has been written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(folder)


def update_ledger(versions: DataFrame, folder: str, content_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan the blobs that the ledger in ``folder`` lacks, append their entries, and return the whole ledger."""
    spark = versions.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    known = read_ledger(spark, folder) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
    ledger_entries(versions, content_col, known, rules, rule_version).write.mode("append").parquet(folder)
    return read_ledger(spark, folder)


def secret_scan(versions: DataFrame, id_col: str = "doc_id", content_col: str = "text", folder: str | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans of every version, scanning only what the ledger in ``folder`` (None: a new one in the shared folder) lacks."""
    known = update_ledger(versions, folder or fresh_path(versions.sparkSession, "ledger"), content_col, rules, rule_version)
    found = findings_by_path(versions, known, id_col, content_col, rule_version)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *(count(r.kind) for r in BASE_RULES), F.sha2(rendered(base), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))

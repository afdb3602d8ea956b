"""Secret scans on an incremental ledger of content-addressed blobs.

A version of a document is known by where it is (its path, here ``doc_id``) and by what it is: the
SHA-256 of its text, the blob.  The ledger in a folder has which blob was scanned with which version of
which rule, and what was found.  A scan hashes every version given, historical ones too, takes the
pairs of blob and rule version that the ledger lacks, fetches one copy of each such blob's
text, runs only the rules it still needs, adds to the ledger and joins the findings of all the
blobs back to all their paths.  A secret that moved, or came back, is found without another scan; a
changed rule rescans for that rule alone.

Findings are written before the pairs they belong to, so a run that is lost in between scans these pairs
again; equal findings count once.  The ledger's folder is a parameter; where none is given it is the one that the session's
``marlstone.secrets.ledger`` names, and a new one in the shared folder without that.  Hashing is narrow.  Texts are filtered by strings that any match must have before they are
hashed again and joined with the blobs to scan, so only texts that may have a secret can be shuffled, and they are only if
the blobs are too many for a broadcast (``checked_broadcast``).

Patterns take whole runs, of any length, so nothing of a long secret stays behind when it is replaced; a private key without an end takes
all that follows and may belong to it.  A version without text has
no blob, an empty one has no findings; a null path is a path like others; versions that repeat are
one, and of several paths of a blob the smallest is read.  Very long texts are scanned whole.  An empty table adds nothing.  Other columns are ignored or passed on, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.ngram_join import checked_broadcast
from marlstone.llm.store import shared_dir, written


@dataclass(frozen=True)
class Rule:
    """A regular expression (in the common ground of Java's and RE2's syntax), and strings one of which any match must have (in lower case if ``fold``)."""

    name: str
    version: int
    pattern: str
    needs: tuple[str, ...] = ()
    fold: bool = False

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    def may_match(self, text: Column) -> Column:
        text = F.lower(text) if self.fold else text
        out = F.lit(not self.needs)
        for s in self.needs:
            out = out | F.contains(text, F.lit(s))
        return out


_SPACE = r" \t\n\x0b\f\r"
RULES = (
    Rule("aws_access_key", 1, r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", ("AKIA", "ASIA")),
    Rule("github_token", 2, r"\bgh[pousr]_[0-9A-Za-z]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack_token", 2, r"\bxox[abprs]-[0-9A-Za-z-]{10,}", ("xox",)),
    Rule("google_api_key", 2, r"\bAIza[0-9A-Za-z_-]{35,}", ("AIza",)),
    Rule("payment_key", 2, r"\b[prs]k_(?:live|test)_[0-9A-Za-z]{16,}", ("k_live_", "k_test_")),
    Rule("json_web_token", 1, r"\beyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}", ("eyJ",)),
    Rule("private_key", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?s:.*?)-----END [A-Z ]*PRIVATE KEY-----|[0-9A-Za-z+/=" + _SPACE + r"]*)", ("PRIVATE KEY-----",)),
    Rule("url_password", 2, r"[a-z][a-z0-9+.-]{0,30}://[^" + _SPACE + r":/@]+:[^" + _SPACE + r"/@]+@[^" + _SPACE + r"/]+", ("://",)),
    Rule("assigned_secret", 2, r"(?i:password|passwd|secret|token|api[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?[^" + _SPACE + r"\"'`<>(){}\[\],;]{12,}[\"']?", ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key"), True),
)

BLOB_ROW = 600
"""Bytes that a blob with its rules takes in a hashed relation."""
_SCANNED = "blob string, rules array<string>"
_FINDINGS = "blob string, rule string, version int, secret string"


class Ledger:
    """Tables of scanned pairs and of findings under one folder that executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or spark.conf.get("marlstone.secrets.ledger", None) or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", _SCANNED)

    def findings(self) -> DataFrame:
        return self._read("findings", _FINDINGS).distinct()

    def add(self, findings: DataFrame, scanned: DataFrame) -> None:
        findings.write.mode("append").parquet(f"{self.folder}/findings")
        scanned.write.mode("append").parquet(f"{self.folder}/scanned")


def versions(docs: DataFrame) -> DataFrame:
    """(path, blob) of every version that has a text."""
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("path"), F.sha2("text", 256).alias("blob"))


def unseen(history: DataFrame, ledger: Ledger, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, path, rules): blobs with rules that the ledger lacks, with one path that has them."""
    seen = ledger.scanned().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    blobs = history.groupBy("blob").agg(F.min("path").alias("path"))
    every = F.array(*(F.lit(r.key) for r in rules))
    todo = blobs.join(seen, "blob", "left").select("blob", "path", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules"))
    return todo.where(F.size("rules") > 0)


def _found(rule: Rule) -> Column:
    """What one rule finds in ``__text``, if the blob still needs it."""
    text = F.col("__text")
    wanted = F.array_contains("__rules", rule.key) & rule.may_match(text)
    secrets = F.when(wanted, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(secrets, lambda s: F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), s.alias("secret")))


def may_have(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether a text has a string that some rule needs."""
    out = F.lit(False)
    for r in rules:
        out = out | r.may_match(text)
    return text.isNotNull() & out


def scan_blobs(docs: DataFrame, todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of the blobs to do, each blob's text fetched from one path only."""
    small = checked_broadcast(todo.select(F.col("blob").alias("__blob"), F.col("path").alias("__path"), F.col("rules").alias("__rules")), todo.count() * BLOB_ROW)
    own = docs.where(may_have(F.col("text"), rules)).select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").alias("__text"), F.sha2("text", 256).alias("__sha"))
    own = own.join(small, (F.col("__sha") == F.col("__blob")) & F.col("__doc").eqNullSafe(F.col("__path")))
    found = F.flatten(F.array(*(_found(r) for r in rules)))
    return own.select(F.col("__blob").alias("blob"), F.explode(found).alias("f")).select("blob", "f.rule", "f.version", "f.secret").distinct()


def scan(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date with the versions; (path, blob, rule, version, secret) of each finding of them.

    Only findings of the given versions of the rules are returned.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    history = written(versions(docs).distinct(), "history")
    todo = written(unseen(history, ledger, rules), "unseen")
    ledger.add(scan_blobs(docs, todo, rules), todo.select("blob", "rules"))
    current = F.concat_ws("@", "rule", "version").isin([r.key for r in rules])
    return history.join(ledger.findings().where(current), "blob").select("path", "blob", "rule", "version", "secret")


def secret_findings(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rule, version, secret_sha256): each secret of each document once, told by its hash."""
    return scan(docs, ledger, rules).select(F.col("path").alias("doc_id"), "rule", "version", F.sha2("secret", 256).alias("secret_sha256")).distinct()


def redacted(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every secret found replaced by ``[rule]``; all rows and columns stay.

    ``n_chars``, if there, is counted again where a text changes.
    """
    hit = written(scan(docs, ledger, rules).select("path", "blob").distinct(), "hits")
    hit = checked_broadcast(hit, hit.count() * BLOB_ROW // 2).withColumn("hit", F.lit(True))
    own = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), F.when(may_have(F.col("text"), rules), F.sha2("text", 256)).alias("sha"))
    own = own.join(hit, F.col("id").eqNullSafe(F.col("path")) & (F.col("sha") == F.col("blob")), "left")
    clean = F.col("doc.text")
    for r in rules:
        clean = F.regexp_replace(clean, F.lit(r.pattern), F.lit(f"[{r.name}]"))
    own = own.withColumn("clean", F.when(F.col("hit"), clean))
    new = {"text": F.coalesce("clean", "doc.text"), "n_chars": F.coalesce(F.length("clean"), "doc.n_chars") if "n_chars" in docs.columns else None}
    return own.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in docs.columns))

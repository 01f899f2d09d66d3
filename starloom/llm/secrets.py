"""Secrets in texts: patterns with spans, and weak candidates linked with their complementary parts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.tables import packed_rows

# Fixed patterns; a capture group that decides on the length is named by its number.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ with 24 characters or more
# Weak candidates: too common to report alone.
CLIENT = r"""(?i:(client_?id|account_?id|user(?:name)?|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.=-]+)"""
KEY = r"[A-Za-z0-9/+]{40,}"  # reported at exactly 40 characters
ENDPOINT = r"""(?i:https?|s3|ftp|postgres|mysql|redis|mongodb|amqp)://[^\x00-\x20"'<>|]+"""
KINDS = ["assign", "access", "hex", "client", "key", "endpoint"]  # order of equal starts
SCOPE = 256  # code points between the parts of one credential
SPAN = "array<struct<start:int,end:int>>"


def _spans(text: Column, pattern: str, may_match: Column, decides: int = 0, least: int = 1, most: int | None = None) -> Column:
    """Spans (start, end in code points) of the leftmost non-overlapping matches whose group ``decides`` has ``least`` to ``most`` characters.

    A match's place follows from the lengths of the matches and of the pieces between them. ``may_match`` is a cheap test
    that spares texts without a match the rest.
    """
    regex = F.lit(pattern)
    group = F.regexp_extract_all(text, regex, F.lit(decides))
    between = F.split(text, pattern, -1)

    def described(match: Column, i: Column) -> Column:
        length = F.length(F.get(group, i))
        fits = length >= least if most is None else (length >= least) & (length <= most)
        return F.struct(F.length(F.get(between, i)).alias("gap"), F.length(match).alias("length"), fits.alias("fits"))

    def placed(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["length"]).alias("end"))
        return F.struct((start + x["length"]).alias("at"), F.when(x["fits"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    matches = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), described)
    nothing = F.array().cast(SPAN)
    found = F.aggregate(matches, F.struct(F.lit(0).alias("at"), nothing.alias("spans")), placed, lambda s: s["spans"])
    return F.when(may_match, found).otherwise(nothing)


def _near(spans: Column, x: Column) -> Column:
    """Whether an interval of ``spans`` meets that of ``x`` widened by ``SCOPE`` on both sides."""
    return F.exists(spans, lambda s: (s["start"] < x["end"] + SCOPE) & (s["end"] > x["start"] - SCOPE))


def _apart(spans: Column, x: Column) -> Column:
    return ~F.exists(spans, lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"]))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan_secrets(documents: DataFrame, text: Column | None = None) -> DataFrame:
    """Add to each row the spans of its ``text`` (a column of that name by default): ``secret_base`` and ``secret_spans``, sorted arrays of (start, order, kind, end).

    Base spans are ``assign`` (a value of 6 characters or more), ``access`` (20 or more) and ``hex`` (24 or more).
    Weak candidates are client names (``client``), bare keys of 40 characters (``key``) and addresses (``endpoint``).
    They are linked by an interval join within the document: two parts belong to one scope if less than ``SCOPE`` code
    points lie between them. A key is reported if an identifier (access or client) is in its scope; a client name if a
    secret (assign, hex or key) and an endpoint are; an endpoint if an identifier and a secret are. Candidates
    that overlap a base span are not reported again. ``secret_spans`` has base and linked spans.

    A scope never leaves its document, so nothing is shuffled, and the join compares the parts of one text only. A null or
    empty text has no spans; repeated rows get equal ones; columns of these two names are replaced, others untouched.
    """
    documents = documents.drop("secret_base", "secret_spans", "__parts")
    text = F.coalesce((F.col("text") if text is None else text).cast("string"), F.lit(""))
    parts = documents.withColumn(
        "__parts",
        F.struct(
            _spans(text, ASSIGN, text.rlike(ASSIGN), decides=2, least=6).alias("assign"),
            _spans(text, ACCESS, F.contains(text, F.lit("AKIA")), least=20).alias("access"),
            _spans(text, HEX, text.rlike(HEX), least=24).alias("hex"),
            _spans(text, CLIENT, text.rlike(CLIENT), decides=2, least=3).alias("client"),
            _spans(text, KEY, text.rlike(KEY), least=40, most=40).alias("key"),
            _spans(text, ENDPOINT, F.contains(text, F.lit("://"))).alias("endpoint"),
        ),
    )
    p = F.col("__parts")
    def linked(p: Column) -> Column:
        identifiers, secrets = F.concat(p["access"], p["client"]), F.concat(p["assign"], p["hex"], p["key"])
        known = F.concat(p["assign"], p["access"], p["hex"])
        client = F.filter(p["client"], lambda x: _apart(known, x) & _near(secrets, x) & _near(p["endpoint"], x))
        key = F.filter(p["key"], lambda x: _apart(known, x) & _near(identifiers, x))
        endpoint = F.filter(p["endpoint"], lambda x: _apart(known, x) & _near(identifiers, x) & _near(secrets, x))
        return F.concat(_named("client", client), _named("key", key), _named("endpoint", endpoint))

    weak = F.size(p["client"]) + F.size(p["key"]) + F.size(p["endpoint"]) > 0
    named = F.concat(_named("assign", p["assign"]), _named("access", p["access"]), _named("hex", p["hex"]))
    sorted_base = F.array_sort(named)
    out = parts.withColumn("secret_base", sorted_base)
    out = out.withColumn("secret_spans", F.when(weak, F.array_sort(F.concat("secret_base", linked(p)))).otherwise(F.col("secret_base")))
    return out.drop("__parts")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (``kind:start:end``, comma-joined) of each row."""
    scanned = scan_secrets(documents.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secret_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans_text(F.col("secret_base")), 256).alias("base_sha256"), spans_text(F.col("secret_spans")).alias("spans"))


def redact_secrets(documents: DataFrame, length_column: str = "n_chars") -> DataFrame:
    """``documents`` with every reported span of its text replaced by ``[KIND]``, its columns in order.

    Overlapping spans become one. Where a text changes, ``length_column`` (if there is one) gets its new length. A null text stays null.
    """
    scanned = scan_secrets(packed_rows(documents), F.col("row.text"))
    text, spans = F.col("row.text"), F.col("secret_spans")

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        before = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        done = F.when(fresh, F.concat(state["done"], before, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(state["done"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), done.alias("done"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    redacted = F.aggregate(spans, start, step, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))))
    changed = scanned.select("row", F.when(F.size(spans) > 0, redacted).alias("new"))
    values = {c: F.col("row")[c] for c in documents.columns}
    values["text"] = F.coalesce("new", "row.text")
    if length_column in values:
        kind = documents.schema[length_column].dataType
        values[length_column] = F.when(F.col("new").isNotNull(), F.length("new").cast(kind)).otherwise(values[length_column])
    return changed.select(*[c.alias(name) for name, c in values.items()])

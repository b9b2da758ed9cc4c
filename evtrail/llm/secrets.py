"""Secret scans with multipart credential linking, DataFrame functions only.

Strong matches (assignments, access ids, long hex runs) are reported as they
stand.  Weak candidates (account names, bare 40-character keys, endpoints)
are reported only when a complementary part of the same credential lies
within ``scope`` code points: a key needs an identifier or an endpoint, an
identifier needs a secret, an endpoint needs a secret or an identifier.

Plan.  One scan: a row-wise prefilter, then each pattern's matches are framed
by a marker, the text is split at the markers and the piece lengths (never
the texts) are exploded, so positions are a running sum over one text's
pieces.  The link is an interval join on (document, bin of ``scope`` code
points): each bin is first reduced to the least and greatest place a part of
each class has in it, so a candidate meets its own bins and one on either
side and pairs are never built, however many parts a document holds.  Parts
of one kind do not overlap, so the bins they touch are bounded by the length
of the text.  Documents are keyed by
id and text hash; only parts and (id, hash) are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evtrail.llm.common import materialize, read_table
from evtrail.llm.registry import query

# Kinds in report order, their pattern, part class
# (I identifier, S secret, E endpoint), strength, and what decides a match:
# the least length of the whole match, or of the value that ends it.
KINDS = [
    # kind, pattern, class, weak, least length, of value only
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
     "S", False, 6, True),
    ("access", r"AKIA[A-Z0-9]+", "I", False, 20, False),
    ("hex", r"[0-9a-f]{24,}", "S", False, 24, False),
    ("account", r"(?i:user(?:name)?|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@_.-]{3,})",
     "I", True, 3, True),
    ("key", r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_-])", "S", True, 40, False),
    ("endpoint", r"(?i:https?|ftps?|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+",
     "E", True, 8, False),
]
COMPLEMENTS = {"account": ("S",), "key": ("I", "E"), "endpoint": ("S", "I")}
BARE = ("hex", "key")
BASE_KINDS = ("assign", "access", "hex")
SCOPE = 200

# the frame character is a private-use code point; one already in a text is
# replaced by another of equal length that no pattern accepts either
_MARK, _OTHER = "\ue000", "\ue001"


def _any_kind() -> str:
    """A cheap pattern that every text with any match satisfies."""
    return (r"[:=]|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/]{40}")


def _pieces(text: Column, pattern: str, least: int, of_value: bool) -> Column:
    """array<struct<pos, len, hit>>: the pieces between and at the matches."""
    framed = F.regexp_replace(text, pattern, _MARK + "$0" + _MARK)
    parts = F.split(framed, _MARK, -1)
    enough = ((lambda p: F.length(F.regexp_extract(p, pattern, 1)) >= least) if of_value
              else (lambda p: F.length(p) >= least))
    cut = F.transform(parts, lambda p, i: F.struct(
        i.alias("pos"), F.char_length(p).alias("len"),
        F.when(i % 2 == 1, enough(p)).otherwise(F.lit(False)).alias("hit")))
    return F.when(text.rlike(pattern), cut).otherwise(F.expr("array()").cast(
        "array<struct<pos:int,len:int,hit:boolean>>"))


def _parts(docs: DataFrame, kinds) -> DataFrame:
    """(id, h, kind, start, end) of every match of every kind, each distinct text once."""
    t = docs.where(F.col("t").rlike(_any_kind()))
    t = t.select("id", "h", F.translate("t", _MARK, _OTHER).alias("t"))
    per_kind = F.array(*[F.struct(F.lit(k).alias("kind"), _pieces(F.col("t"), p, n, v).alias("ps"))
                         for k, p, _, _, n, v in kinds])
    rows = (t.select("id", "h", F.explode(per_kind).alias("k")).where(F.size("k.ps") > 0)
            .select("id", "h", "k.kind", F.explode("k.ps").alias("p"))
            .select("id", "h", "kind", "p.pos", "p.len", "p.hit").distinct())
    # a stable sort order and a frame that streams: one text's pieces of one kind
    w = (Window.partitionBy("id", "h", "kind").orderBy("pos")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.sum(F.col("len").cast("long")).over(w)
    return (rows.withColumn("end", end).where("hit")
            .select("id", "h", "kind", (F.col("end") - F.col("len")).alias("start"), "end"))


def _link(parts: DataFrame, kinds, scope: int, gap: bool) -> DataFrame:
    """Keep strong parts, and weak parts with a complementary part within
    ``scope``: from the end of one to the start of the next (``gap``), else
    from start to start.  Over a gap, a part without a name (a hex run, a bare
    key) and the part it overlaps are no evidence for each other: a hash
    inside an address does not make the address an endpoint of a credential,
    a ``password=`` inside it does."""
    lookup = lambda i: F.create_map(*[F.lit(x) for k in kinds for x in (k[0], k[i])])
    parts = parts.withColumn("class", lookup(2)[F.col("kind")]).withColumn("weak", lookup(3)[F.col("kind")])
    if gap:
        named = parts.where(~F.col("kind").isin(*BARE)).withColumn("stop", F.col("end"))
        linked = _within(named, scope).unionByName(_apart(parts, scope)).distinct()
    else:
        linked = _within(parts.withColumn("stop", F.col("start")), scope).distinct()
    return parts.where("not weak").select("id", "h", "kind", "start", "end").unionByName(linked)


def _within(parts: DataFrame, scope: int) -> DataFrame:
    """The weak parts with a complementary part within ``scope`` of [start, stop]."""
    of = lambda x: F.floor(x / scope).cast("long")
    # least and greatest place of each class in each bin it touches: a
    # candidate's reach is longer than a bin, so it takes a bin's beginning,
    # its end or all of it, and the two decide without pairing parts
    bins = (parts.withColumn("near", F.explode(F.sequence(of(F.col("start")), of(F.col("stop")))))
            .groupBy("id", "h", "near", F.col("class").alias("other")).agg(
                F.min(F.greatest("start", F.col("near") * scope)).alias("lo"),
                F.max(F.least("stop", F.col("near") * scope + scope - 1)).alias("hi")))
    needs = F.create_map(*[x for k, c in COMPLEMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, c)))])
    cand = (parts.where("weak")
            .withColumn("near", F.explode(F.sequence(of(F.col("start")) - 1, of(F.col("stop")) + 1)))
            .withColumn("other", F.explode(needs[F.col("kind")])))
    c, b = cand.alias("c"), bins.alias("b")
    return (c.join(b, F.col("c.id").eqNullSafe(F.col("b.id")) & (F.col("c.h") == F.col("b.h"))
                   & (F.col("c.near") == F.col("b.near")) & (F.col("c.other") == F.col("b.other"))
                   & (F.col("b.lo") <= F.col("c.stop") + scope) & (F.col("b.hi") >= F.col("c.start") - scope))
            .select("c.id", "c.h", "c.kind", "c.start", "c.end"))


def _apart(parts: DataFrame, scope: int) -> DataFrame:
    """The weak parts with a complementary part that lies outside them: it ends
    at most ``scope`` before the candidate starts, or starts at most ``scope``
    after it ends.

    Each part stands with its end and with its start in one bin of ``scope``
    places; a candidate asks the bin of its own start and the one before for
    ends, the bin of its own end and the next for starts.  Of a bin's places
    the least and the greatest decide, so no two parts are paired.
    """
    of = lambda x: F.floor(x / scope).cast("long")
    place = F.explode(F.array(F.struct(F.lit("end").alias("side"), F.col("end").alias("at")),
                              F.struct(F.lit("start").alias("side"), F.col("start").alias("at"))))
    bins = (parts.select("id", "h", F.col("class").alias("other"), place.alias("p"))
            .groupBy("id", "h", "other", "p.side", of(F.col("p.at")).alias("near"))
            .agg(F.min("p.at").alias("lo"), F.max("p.at").alias("hi")))
    needs = F.create_map(*[x for k, c in COMPLEMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, c)))])
    ask = lambda side, at, shift, low, high: F.struct(
        F.lit(side).alias("side"), (of(at) + shift).alias("near"), low.alias("low"), high.alias("high"))
    s, e = F.col("start"), F.col("end")
    asks = F.array(*[ask("end", s, i, s - scope, s) for i in (-1, 0)], *[ask("start", e, i, e, e + scope) for i in (0, 1)])
    cand = (parts.where("weak").select("id", "h", "kind", "start", "end", F.explode(asks).alias("q"))
            .withColumn("other", F.explode(needs[F.col("kind")])))
    c, b = cand.alias("c"), bins.alias("b")
    return (c.join(b, F.col("c.id").eqNullSafe(F.col("b.id")) & (F.col("c.h") == F.col("b.h"))
                   & (F.col("c.q.side") == F.col("b.side")) & (F.col("c.q.near") == F.col("b.near"))
                   & (F.col("c.other") == F.col("b.other"))
                   & (F.col("b.lo") <= F.col("c.q.high")) & (F.col("b.hi") >= F.col("c.q.low")))
            .select("c.id", "c.h", "c.kind", "c.start", "c.end"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all columns), id, t, h: whatever the columns of ``docs`` are called."""
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    own = own.select("row", F.col("row")[id_col].alias("id"),
                     F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")).alias("t"))
    return own.withColumn("h", F.xxhash64("t", F.char_length("t")))


def _found(own: DataFrame, scope: int, gap: bool) -> DataFrame:
    """(id, h, spans) of the texts that have any."""
    found = _link(materialize(_parts(own.select("id", "h", "t"), KINDS), "secret-parts"), KINDS, scope, gap)
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k[0], i)])
    return found.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct(
        "start", rank[F.col("kind")].alias("rank"), "kind", "end"))).alias("spans"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE,
                 gap: bool = False) -> DataFrame:
    """One row per input row: ``<id>`` and ``spans``, an array of
    (start, rank, kind, end) in report order, code points, end exclusive.
    Parts are linked over at most ``scope`` code points between them with
    ``gap`` (the query and redaction), else between their starts.

    Defined cases: a null or empty text has no spans; rows that repeat an id
    with another text are scanned apart, rows that repeat id and text get
    the same spans; a null id is a value like any other; an empty table
    gives an empty result; other columns are not read.
    """
    own = _keyed(docs, id_col, text_col)
    o, s = own.select("id", "h").alias("o"), _found(own, scope, gap).alias("s")
    out = o.join(s, F.col("o.id").eqNullSafe(F.col("s.id")) & (F.col("o.h") == F.col("s.h")), "left")
    none = F.expr("array()").cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return out.select(F.col("o.id").alias(id_col), F.coalesce("s.spans", none).alias("spans"))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE,
                   mask: str = "[SECRET]", length_col: str | None = None, gap: bool = True) -> DataFrame:
    """``docs`` with every reported span replaced by ``mask`` (overlapping
    spans by one mask) and, where a text changed, its code points in
    ``length_col``.  Rows, columns and their order stay as in ``docs``;
    a text without a span is left as it is, null included.  Texts are only
    shuffled if the spans of the texts that have any are too large to
    broadcast."""
    own = _keyed(docs, id_col, text_col)
    hits = materialize(_found(own, scope, gap), "secret-spans").alias("s")
    o = own.alias("o")
    j = o.join(hits, F.col("o.id").eqNullSafe(F.col("s.id")) & (F.col("o.h") == F.col("s.h")), "left")
    t = F.col("o.t")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(
        s["end"].alias("at"),
        F.concat(a["out"], t.substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                 F.lit(mask)).alias("out"))).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"),
                                                                a["out"].alias("out")))
    done = lambda a: F.concat(a["out"], t.substr((a["at"] + 1).cast("int"), F.char_length(t)))
    j = j.select("o.row", F.when(F.col("s.spans").isNotNull(), F.aggregate("s.spans", start, step, done)).alias("new"))
    kinds = dict(docs.dtypes)
    return j.select(*[
        F.coalesce("new", F.col("row")[c]).alias(c) if c == text_col
        else F.coalesce(F.char_length("new").cast(kinds[c]), F.col("row")[c]).alias(c) if c == length_col
        else F.col("row")[c].alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan_secrets(read_table(spark, sf_dir, "documents"), gap=True)
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return s.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                    F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))

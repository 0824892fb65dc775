"""Secret scan: pattern spans in every text, and weak parts that become spans only beside complementary ones.

Base kinds are fixed patterns. Weak parts are other access identifiers (shorter, of other prefixes, or any value behind
the label of a client, key, user or account), bare 40-character secrets and service endpoints. A secret is linked where an access identifier (base or weak) lies within ``scope`` code points of it, a weak
identifier where a secret does, an endpoint where both do. The link is an interval join over cells of the scope's length:
each cell holds the outermost ends of the parts of each role that touch it, and a part looks into every cell that it, or
the scope on either side of it, touches (parts that share a cell leave less than the scope between them), so a text with many parts costs rows in proportion to them. DataFrame functions only; positions are code points.

Defined results: null or empty text: no spans, digest of the empty string; repeated rows get equal results; documents
without weak parts take no part in the join; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.native_text import let, text_of
from quillon.llm.scratch import Scratch

ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ["assign", "access", "hex", "linked_access", "linked_secret", "linked_endpoint"]
SPAN = "array<struct<start:int,kind:int,stop:int>>"
#: Labelled values that are base identifiers or look like bare secrets are left to those kinds.
LABELLED = r"""(?<![A-Za-z0-9])(?<!(?i:secret)[_-])(?i:client[_-]?id|(?:access[_-]?)?key[_-]?id|access[_-]?key|(?:user|account)(?:[_-]?(?:id|name))?)["']?\x20*[:=]\x20*["']?(?!AKIA[A-Z0-9]{16})(?![A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-]))[A-Za-z0-9_.@+-]{3,}"""
LABEL_END = r"""(?:id|key|name|user|account)["']?\x20*[:=]"""  # of lower-case text: a cheap test for labels
WEAK_ACCESS = LABELLED + r"|(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{8,15}|(?:ASIA|AIDA|AROA)[A-Z0-9]{8,})(?![A-Z0-9])"
BARE_SECRET = r"(?<![A-Za-z0-9+/=_.-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-])"
ENDPOINT = r"https?://[^\s\"'<>]+"


def find_spans(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, kind, stop); matches whose ``group`` is under ``least`` long are dropped."""
    lengths = lambda x: F.transform(x, lambda y: F.length(y))
    whole = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    judged = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    all_ = F.struct(lengths(F.split(text, pattern, -1)).alias("gap"), whole.alias("whole"), judged.alias("judged"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def fold(m: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            start = s["at"] + F.get(m["gap"], k)
            stop = start + F.get(m["whole"], k)
            one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop")))
            return F.struct(stop.alias("at"), F.when(F.get(m["judged"], k) >= least, F.concat(s["found"], one)).otherwise(s["found"]).alias("found"))

        ranks = F.when(F.size(m["whole"]) > 0, F.sequence(F.lit(0), F.size(m["whole"]) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(ranks, zero, step, lambda s: s["found"])

    return let(all_, fold)


def guarded(text: Column, present: Column, *args) -> Column:
    """Spans, evaluated only where a cheap test says that there may be some."""
    return F.when(present, find_spans(text, *args)).otherwise(F.array().cast(SPAN))


def digest(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def parts_of(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the arrays base, weak, and the columns ``carry``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *carry)
    text = F.col("text")
    low = F.lower(text)
    word = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api_key")) | F.contains(low, F.lit("apikey"))
    any_id = F.contains(text, F.lit("AKIA")) | F.contains(text, F.lit("ASIA")) | F.contains(text, F.lit("AIDA")) | F.contains(text, F.lit("AROA")) | F.rlike(low, F.lit(LABEL_END))
    base = F.concat(
        guarded(text, word, ASSIGN, 0, 6, 1),
        guarded(text, F.contains(text, F.lit("AKIA")), "AKIA[A-Z0-9]+", 1, 20),
        guarded(text, F.rlike(text, F.lit("[0-9a-f]{24}")), "[0-9a-f]+", 2, 24),
    )
    weak = F.concat(guarded(text, any_id, WEAK_ACCESS, 3), guarded(text, any_id, BARE_SECRET, 4), guarded(text, any_id, ENDPOINT, 5))
    return rows.select("doc_id", "text", F.array_sort(base).alias("base"), F.array_sort(weak).alias("weak"), *carry)


def link(found: DataFrame, scope: int) -> DataFrame:
    """(doc_id, mark, linked): the weak parts of ``found`` (doc_id, mark, base, weak) that have their complements near."""
    role = F.when(F.col("p.kind").isin(1, 3), "access").when(F.col("p.kind").isin(0, 2, 4), "secret").otherwise("endpoint")
    parts = found.select("doc_id", "mark", F.explode(F.array_distinct(F.concat("base", "weak"))).alias("p")).distinct()
    touched = lambda reach: F.explode(F.sequence(F.floor((F.col("p.start") - reach) / scope), F.floor((F.col("p.stop") + reach) / scope))).alias("cell")
    weak = parts.where("p.kind >= 3").select("doc_id", "mark", "p", touched(scope))
    parts = parts.select("doc_id", "mark", "p", role.alias("role"), touched(0))
    edge = parts.groupBy("doc_id", "mark", "cell").agg(*(f(F.when(F.col("role") == r, F.col(f"p.{c}"))).alias(f"{r}_{n}") for r in ("access", "secret") for n, f, c in (("lo", F.min, "start"), ("hi", F.max, "stop"))))
    same = (F.col("w.cell") == F.col("e.cell")) & F.col("w.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("w.mark") == F.col("e.mark"))
    near = lambda r: F.coalesce((F.col(f"e.{r}_lo") <= F.col("w.p.stop") + scope) & (F.col(f"e.{r}_hi") >= F.col("w.p.start") - scope), F.lit(False))
    seen = weak.alias("w").join(edge.alias("e"), same).select("w.doc_id", "w.mark", "w.p", near("access").alias("a"), near("secret").alias("s"))
    per = seen.groupBy("doc_id", "mark", "p").agg(F.max("a").alias("a"), F.max("s").alias("s"))
    ok = F.when(F.col("p.kind") == 3, F.col("s")).when(F.col("p.kind") == 4, F.col("a")).otherwise(F.col("a") & F.col("s"))
    return per.where(ok).groupBy("doc_id", "mark").agg(F.collect_list("p").alias("linked"))  # parts of one text


def scan_secrets(docs: DataFrame, scope: int = 300) -> DataFrame:
    """doc_id, mark (hash of the text), base, spans: arrays of (start, kind number, stop), sorted."""
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.table(parts_of(docs).select("doc_id", F.xxhash64("text").alias("mark"), "base", "weak"), "parts")
    plain = found.where(F.size("weak") == 0).select("doc_id", "mark", "base", F.col("base").alias("spans"))
    open_ = found.where(F.size("weak") > 0)
    linked = link(open_, scope).select(F.col("doc_id").alias("its_id"), F.col("mark").alias("its_mark"), "linked")
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("mark") == F.col("its_mark"))
    spans = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(SPAN))))
    joined = open_.join(linked, same, "left").select("doc_id", "mark", "base", spans.alias("spans"))
    return plain.union(joined)


def secret_report(docs: DataFrame, scope: int = 300) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = scan_secrets(docs, scope)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with every span (sorted, may overlap) replaced."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, x):
        gap = F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        new = F.when(x["start"] >= s["at"], F.concat(s["out"], gap, F.lit(mask))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), new.alias("out"))

    end = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    return F.aggregate(spans, zero, step, end)


def redact(docs: DataFrame, scope: int = 300, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced in its text; n_chars, where there is one, follows. Other rows are unchanged."""
    scratch = Scratch(docs.sparkSession, "redact")
    rows = parts_of(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), ("row",))
    plain = rows.where(F.size("weak") == 0).select("row", F.col("base").alias("spans"))
    open_ = scratch.table(rows.where(F.size("weak") > 0).select("doc_id", F.xxhash64("text").alias("mark"), "base", "weak", "row"), "open")
    linked = link(open_, scope).select(F.col("doc_id").alias("its_id"), F.col("mark").alias("its_mark"), "linked")
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("mark") == F.col("its_mark"))
    spans = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(SPAN))))
    rows = plain.union(open_.join(linked, same, "left").select("row", spans.alias("spans")))
    new = F.when(F.size("spans") > 0, masked(F.col("row.text"), F.col("spans"), mask)).otherwise(F.col("row.text"))
    rows = rows.select("row", new.alias("clean"))
    out = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("row.text").isNull() | (F.col("clean") == F.col("row.text")), F.col("row.n_chars")).otherwise(F.length("clean").cast(docs.schema["n_chars"].dataType))
    return rows.select(*(v.alias(c) for c, v in out.items()))

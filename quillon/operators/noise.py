"""Noise and samples for robustness tests, as native expressions. Chance comes from hashes of a key and a seed, so a run repeats itself.

Defined results: null text stays null; text without a place for a change stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.spans import iou, let, match_spans
from quillon.functions.text import FOLD_FROM, fold_accents, group_by_three, raw_digits
from quillon.operators import vocabulary as v

#: How OCR misreads letters and digits.
OCR_SWAPS = {"e": "c", "m": "rn", "o": "0", "O": "0", "0": "O", "1": "l", "5": "S"}
LIGHT_SWAPS = (("e", "c"), ("o", "0"), ("m", "rn"))


def draw(*key: Column | str | int) -> Column:
    """A number in [0, 1) fixed by the key."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def pick(n: Column, *key: Column | str | int) -> Column:
    """One of 0..n-1, fixed by the key; 0 where n is 0."""
    return F.floor(draw(*key) * F.greatest(n, F.lit(1))).cast("int")


def substitute(text: Column, start: Column, stop: Column, by: Column) -> Column:
    """Text with [start, stop) replaced."""
    return F.concat(F.substring(text, F.lit(1), start), by, F.substring(text, stop + 1, F.length(text)))


def shifted(at: Column, stop: Column, delta: Column) -> Column:
    """An offset after a replacement that ended at ``stop`` and grew the text by ``delta``."""
    return F.when(at >= stop, at + delta).otherwise(at)


def _places(text: Column, ok) -> Column:
    """Zero-based positions of characters for which ``ok`` holds."""
    n = F.length(text)
    all_ = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(all_, lambda i: ok(F.substring(text, i + 1, F.lit(1))))


def light(text: Column, key: Column, seed: int = 42) -> Column:
    """At a chance of 0.3 one accent lost; then each of three misreadings tried at 0.25 until one applies, at its first place."""
    accents = lambda t: _places(t, lambda c: (fold_accents(c) != c) & F.contains(F.lit(FOLD_FROM), c))

    def lose(t: Column) -> Column:
        def at(p: Column) -> Column:
            i = F.get(p, pick(F.size(p), key, seed, "accent"))
            return F.when(F.size(p) > 0, substitute(t, i, i + 1, fold_accents(F.substring(t, i + 1, F.lit(1))))).otherwise(t)

        return let(accents(t), at)

    def swap(t: Column) -> Column:
        out = t
        for k, (a, b) in reversed(list(enumerate(LIGHT_SWAPS))):
            hit = (draw(key, seed, "swap", k) < 0.25) & F.contains(t, F.lit(a))
            at = F.instr(t, a) - 1
            out = F.when(hit, substitute(t, at, at + len(a), F.lit(b))).otherwise(out)
        return out

    return let(F.when(draw(key, seed, "lose") < 0.3, lose(text)).otherwise(text), swap)


def reformat_number(number: Column, style: Column) -> Column:
    """Digits in one of four styles: 0 plain, 1 dots, 2 spaces, 3 dots and a space before the last group."""
    d = raw_digits(number)
    dots = group_by_three(d)
    return F.when(style == 0, d).when(style == 1, dots).when(style == 2, group_by_three(d, " ")).otherwise(F.regexp_replace(dots, "\\.([^.]*)$", ". $1"))


def ocr(text: Column, key: Column, most: int = 2, seed: int = 42) -> Column:
    """Up to ``most`` characters misread, at places in hash order."""
    table = F.create_map(*(F.lit(x) for pair in OCR_SWAPS.items() for x in pair))
    ordered = lambda t: F.slice(F.array_sort(F.transform(_places(t, lambda c: c.isin(*OCR_SWAPS)), lambda i: F.struct(draw(key, seed, i).alias("h"), i.alias("i")))), 1, most)

    def apply(chosen: Column) -> Column:
        spots = F.transform(chosen, lambda s: s["i"])
        n = F.length(text)
        chars = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: let(F.substring(text, i + 1, F.lit(1)), lambda c: F.when(F.array_contains(spots, i), F.element_at(table, c)).otherwise(c)))
        return F.array_join(chars, "")

    return F.when(text.isNotNull(), let(ordered(text), apply))


def line_break(text: Column, key: Column, seed: int = 42) -> Column:
    """One space made a line break."""

    def at(p: Column) -> Column:
        i = F.get(p, pick(F.size(p), key, seed, "break"))
        return F.when(F.size(p) > 0, substitute(text, i, i + 1, F.lit("\n"))).otherwise(text)

    return F.when(text.isNotNull(), let(_places(text, lambda c: c == " "), at))


def swap_synonym(text: Column, key: Column, seed: int = 42) -> Column:
    """The first form of a class that stands alone in the text, changed for another form of its family; only one, so changes don't cascade."""
    out = text
    for family, forms in reversed(list(v.SYNONYMS.items())):
        quoted = "|".join("\\Q" + f + "\\E" for f in sorted(forms, key=len, reverse=True))
        pattern = f"(?<![\\p{{L}}.])(?:{quoted})(?!\\p{{L}})"
        found = F.regexp_extract(text, pattern, 0)
        others = F.filter(F.array(*(F.lit(f) for f in forms)), lambda f: f != found)  # noqa: B023
        by = F.get(others, pick(F.size(others), key, seed, family))
        out = F.when(text.rlike(pattern), F.regexp_replace(text, f"^((?s:.*?)){pattern}", F.concat(F.lit("$1"), F.regexp_replace(by, "([$\\\\])", "\\\\$1")))).otherwise(out)
    return out


def variants(citations: DataFrame, n: int = 5, key: str = "key", text: str = "match", seed: int = 42) -> DataFrame:
    """``citations`` with variant (1..n) and noisy: another form of the class, number in another style (five digits or more), then OCR noise, a line break or nothing."""
    rows = citations.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(n))))
    k = F.xxhash64(F.col(key), F.col("variant"))
    number = F.regexp_extract(text, "[0-9][0-9. ]*[0-9]", 0)
    styled = F.when(F.length(raw_digits(number)) >= 5, F.replace(F.col("_s"), number, reformat_number(number, pick(F.lit(4), k, seed, "style")))).otherwise(F.col("_s"))
    rows = rows.withColumn("_s", swap_synonym(F.col(text), k, seed)).withColumn("_s", styled)
    split = F.when(draw(k, seed, "uf") < 0.5, F.regexp_replace("_s", "\\s*/\\s*([A-Z]{2})$", "-$1")).otherwise(F.col("_s"))
    kind = pick(F.lit(3), k, seed, "kind")
    noisy = F.when(kind == 0, ocr(F.col("_t"), k, 2, seed)).when(kind == 1, line_break(F.col("_t"), k, seed)).otherwise(F.col("_t"))
    return rows.withColumn("_t", split).withColumn("noisy", noisy).drop("_s", "_t")


def stress_report(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(n, span_recall, class_accuracy, link_accuracy): each gold span against its document's first prediction at iou 0.5 or more."""
    p = pred.select("doc", F.col("start").alias("p0"), F.col("stop").alias("p1"), F.col("label").alias("pl"), F.col("id").alias("pid"))
    hit = gold.join(p, "doc").where(iou(F.col("start"), F.col("stop"), F.col("p0"), F.col("p1")) >= 0.5)
    first = hit.groupBy("doc", "g").agg(F.min(F.struct("p0", "p1", "pl", "pid")).alias("m"))
    rows = gold.join(first, ["doc", "g"], "left")
    found = F.col("m").isNotNull()
    same = F.when(found, (F.col("m.pl") == F.col("label")).cast("double"))
    linked = F.when(found & (F.col("label") == "real"), F.coalesce(F.array_contains("ids", F.col("m.pid")), F.lit(False)).cast("double"))
    return rows.agg(F.count("*").alias("n"), F.avg(found.cast("double")).alias("span_recall"), F.avg(same).alias("class_accuracy"), F.avg(linked).alias("link_accuracy"))


def is_vague(label: Column, match: Column) -> Column:
    """Open class and no digit."""
    return (label == "incompleta") & ~match.rlike("[0-9]")


def words(text: Column) -> Column:
    """(start, stop, match) of white-space separated words."""
    return match_spans(F.coalesce(text, F.lit("")), "[^\\s ]+")


def negative_windows(docs: DataFrame, gold: DataFrame, per_doc: int = 8, tries: int = 160, seed: int = 42) -> DataFrame:
    """(doc, start, stop, match): up to ``per_doc`` windows of 4 to 10 words in each document that touch no gold span, out of ``tries`` drawn by hash.

    Draws are weighed within a document's row; its text is cut for the windows that are kept alone.
    """
    taken = gold.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("start", "stop")).alias("gold"))
    rows = docs.select("doc", "text").join(taken, F.col("doc") == F.col("_doc"), "left").select("doc", "text", words(F.col("text")).alias("w"), F.coalesce("gold", F.array().cast("array<struct<start:int,stop:int>>")).alias("gold"))

    def drawn(k: Column) -> Column:
        n = F.least(4 + pick(F.lit(7), F.col("doc"), k, seed, "n"), F.size("w"))
        first = pick(F.size("w") - n + 1, F.col("doc"), k, seed, "i")
        return F.struct(F.get("w", first)["start"].alias("start"), F.get("w", first + n - 1)["stop"].alias("stop"))

    all_ = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), drawn)
    free = lambda x: ~F.exists("gold", lambda s: (s["start"] < x["stop"]) & (s["stop"] > x["start"]))
    kept = F.slice(F.array_distinct(F.filter(all_, free)), 1, per_doc)  # the first of equal windows stays
    enough = F.when(F.size("w") >= 4, kept)  # a filter on w would be pushed down and split the text twice
    chosen = rows.select("doc", "text", F.explode(enough).alias("x"))
    return chosen.select("doc", "x.start", "x.stop", F.substring(F.col("text"), F.col("x.start") + 1, F.col("x.stop") - F.col("x.start")).alias("match"))


def training_windows(docs: DataFrame, gold: DataFrame, seed: int = 42) -> DataFrame:
    """(doc, window_text, label): vague spans by type, and windows that touch no gold span."""
    vague = gold.where(is_vague(F.col("label"), F.col("match"))).select("doc", F.col("match").alias("window_text"), F.concat(F.lit("vago_"), "type").alias("label"))
    return vague.unionByName(negative_windows(docs, gold, seed=seed).select("doc", F.col("match").alias("window_text"), F.lit("negativo").alias("label")))


def hash_order(key: str, seed: int) -> Column:
    """A sign that orders keys by chance, the same in every engine."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)).cast("binary"))


def dealt(rows: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """``rows`` with their rank (from 0) in the hash order of ``key`` within their group, and the size of the group.

    Ranks are counted within the first two signs of the hash and moved on by what precedes these, so a group is no task.
    """
    marked = rows.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, 2))
    sizes = marked.groupBy(F.col(group).alias("_l"), F.col("_b").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    group_of = Window.partitionBy("_l")
    ahead = F.sum("_n").over(group_of.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_l", "_c", F.coalesce(ahead, F.lit(0)).alias("_ahead"), F.sum("_n").over(group_of).alias("_all"))  # at most 256 rows a group
    inside = F.row_number().over(Window.partitionBy(group, "_b").orderBy("_h", key)) - 1
    out = marked.withColumn("_r", inside).join(sizes, F.col(group).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c")))
    return out.select(*rows.columns, (F.col("_r") + F.col("_ahead")).alias("rank"), F.col("_all").alias("size"))


def stress_instances(docs: DataFrame, gold: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """(doc, text, g, start, stop, label, ids): every gold span with a digit in ``n`` noisy forms, each in a copy of its document."""
    rows = gold.select("doc", "g", "start", "stop", "label", "ids").join(docs.select("doc", "text"), "doc")
    real = F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start"))
    rows = rows.withColumn("match", real).where(F.col("match").rlike("[0-9]")).withColumn("key", F.xxhash64("doc", "start"))
    noisy = variants(rows, n, seed=seed)
    name = F.concat_ws("#", "doc", F.col("g").cast("string"), F.col("variant").cast("string"))
    return noisy.select(name.alias("doc"), substitute(F.col("text"), F.col("start"), F.col("stop"), F.col("noisy")).alias("text"), "g", "start", (F.col("start") + F.length("noisy")).alias("stop"), "label", "ids")


_VAGUE = "array<struct<inicio:int,fim:int,tipo:string>>"


def instances(docs: DataFrame, gold: DataFrame, paraphrases: DataFrame, seed: int = 42) -> DataFrame:
    """(instance_id, base_doc_id, nivel, text, vago_citations, kind, original_phrase): every document as it is, and for each
    paraphrase one document in which it takes the place of a vague span of its type, drawn by hash; half of the paraphrases
    are lightly noisy, and the other vague spans of that document move.

    paraphrases: original, paraphrase, type.
    """
    vague = gold.where(is_vague(F.col("label"), F.col("match")))
    item = F.struct(F.col("start").cast("int").alias("inicio"), F.col("stop").cast("int").alias("fim"), F.col("type").alias("tipo"))
    lists = vague.groupBy("doc").agg(F.array_sort(F.collect_list(item)).alias("vague"))  # spans of one document
    levels = gold.groupBy("doc").agg(F.min("level").cast("string").alias("nivel"))
    whole = docs.select("doc", "text").join(lists, "doc", "left").join(levels, "doc", "left").withColumn("vague", F.coalesce("vague", F.array().cast(_VAGUE)))
    none = F.lit(None).cast("string")
    real = whole.select(F.col("doc").alias("instance_id"), F.col("doc").alias("base_doc_id"), "nivel", "text", F.col("vague").alias("vago_citations"), F.lit("real").alias("kind"), none.alias("original_phrase"))

    targets = dealt(vague.select("doc", "start", "stop", "type", F.concat_ws("|", "doc", F.col("start").cast("string")).alias("k")), "type", "k", seed).drop("k")
    drawn = paraphrases.join(targets.groupBy("type").agg(F.first("size").alias("n")), "type")
    drawn = drawn.withColumn("rank", pick(F.col("n"), F.col("paraphrase"), seed, "target").cast("long")).drop("n")
    rows = drawn.join(targets, ["type", "rank"]).join(whole, "doc")
    key = F.xxhash64("paraphrase", F.lit(seed))
    by = F.when(draw(key, "noisy") < 0.5, light(F.col("paraphrase"), key, seed)).otherwise(F.col("paraphrase"))
    rows = rows.withColumn("by", by).withColumn("delta", F.length("by") - (F.col("stop") - F.col("start")))
    move = lambda x: F.struct(shifted(x["inicio"], F.col("stop"), F.col("delta")).cast("int").alias("inicio"), shifted(x["fim"], F.col("stop"), F.col("delta")).cast("int").alias("fim"), x["tipo"].alias("tipo"))
    new = F.struct(F.col("start").cast("int").alias("inicio"), (F.col("start") + F.length("by")).cast("int").alias("fim"), F.col("type").alias("tipo"))
    others = F.transform(F.filter("vague", lambda x: (x["inicio"] >= F.col("stop")) | (x["fim"] <= F.col("start"))), move)
    made = rows.select(F.concat_ws("_", F.lit("synth"), "doc", F.col("start").cast("string"), F.hex(key)).alias("instance_id"), F.col("doc").alias("base_doc_id"), "nivel", substitute(F.col("text"), F.col("start"), F.col("stop"), F.col("by")).alias("text"), F.concat(F.array(new), others).cast(_VAGUE).alias("vago_citations"), F.lit("synthetic").alias("kind"), F.col("original").alias("original_phrase"))
    return real.unionByName(made)


def instance_windows(made: DataFrame) -> DataFrame:
    """(base_doc_id, window_text, label): the phrase that each synthetic instance was given."""
    one = F.get("vago_citations", F.lit(0))
    text = F.substring(F.col("text"), one["inicio"] + 1, one["fim"] - one["inicio"])
    return made.where("kind = 'synthetic'").select("base_doc_id", text.alias("window_text"), F.concat(F.lit("vago_"), one["tipo"]).alias("label"))

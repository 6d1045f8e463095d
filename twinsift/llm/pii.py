"""PII: fixed patterns, and information-theoretic sanitisation of what gives it away.

The patterns find the protected entities. Over the corpus, the information that a term gives about
an entity is log p(e|t) / p(e); set against the entity's own information -log p(e) it is the share
that the term discloses. p(e|t) is what the rest of the corpus tells whoever reads one document: the
smallest of its estimates with ``left_out`` documents left out, smoothed towards p(e). So words beside an
entity that is seen once prove nothing, and a second text, no copy of the first, proves much.
Terms that disclose more than the thresholds allow are generalised or removed wherever they stand,
beside the entity or alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.runtime import checkpoint

#: Patterns and order of the kinds (fixed values of the contract). Runs are possessive and start at
#: their first character, which finds the same matches in time proportional to the text.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Share of an entity's information above which a term is generalised, and removed.
GENERALISE, REMOVE = 0.75, 0.9
#: Documents that p(e) weighs as much as in the estimate of p(e|t).
SMOOTHING = 2.0
#: Joint sightings left out of each estimate: 1 asks for a second text as evidence, 0 takes one as proof.
LEFT_OUT = 1
TERM = r"[\p{L}\p{N}]+"
BLOCK = 256
#: Bits a term, and at most, of the screen that words pass before they are joined with terms (results don't depend on it).
TERM_BITS, SCREEN_BITS = 16, 1 << 20


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once: what a lambda names is else evaluated anew at each of its calls."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sums_before(lengths: Column) -> Column:
    """Sum of the elements before each element, by blocks so that long arrays stay cheap."""
    zero = F.lit(0).cast("long")
    scan = lambda a: F.aggregate(a, F.struct(F.array().cast("array<bigint>").alias("out"), zero.alias("sum")), lambda s, x: F.struct(F.array_append(s["out"], s["sum"]).alias("out"), (s["sum"] + x).alias("sum")))
    cut = lambda each: F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / BLOCK).cast("int")), lambda b: scan(F.slice(each, b * BLOCK + 1, F.lit(BLOCK))))

    def join(blocks: Column) -> Column:
        starts = scan(F.transform(blocks, lambda b: b["sum"]))["out"]
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: F.transform(b["out"], lambda x: x + s)))

    return _let(lengths, lambda each: _let(cut(each), join))


_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def find(text: Column, pattern: Column) -> Column:
    """(start, end, value) of the leftmost matches that don't overlap, in code points."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))

    def placed(steps: Column) -> Column:
        before = _sums_before(F.transform(steps, lambda s: s["b"] + F.length(s["x"])))
        return F.zip_with(before, steps, lambda o, s: F.struct((o + s["b"]).alias("start"), (o + s["b"] + F.length(s["x"])).alias("end"), s["x"].alias("value")))

    # lengths of: what stands before a match, and the match
    steps = lambda found: F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, x: F.struct(b.alias("b"), x.alias("x")))
    spans = lambda found: F.when(F.size(found) > 0, _let(steps(found), placed)).otherwise(F.array().cast(_SPAN))
    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), spans)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("odd")),
        lambda s, c: F.struct((s["sum"] + F.when(s["odd"] == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))).alias("sum"), (1 - s["odd"]).alias("odd")),
    )
    return total["sum"] % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?){3}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda s: _valid(kind, s["value"])


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and an array of spans for each kind."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, pattern in KINDS.items():
        all_ = F.when(F.col("text").rlike(HINTS[kind]), find(F.col("text"), F.lit(pattern))).otherwise(F.array().cast(_SPAN))
        docs = docs.withColumn(kind, F.filter(all_, _keeps(kind)))
    return docs


def _entities() -> Column:
    plain = {"email": F.lower, "ip": lambda x: x, "card": lambda x: F.regexp_replace(x, "[^0-9]", ""), "phone": lambda x: F.regexp_replace(x, "[^0-9]", "")}


    def one(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.concat(F.lit(f"{kind}:"), plain[kind](s["value"])).alias("entity"), s["value"].alias("value")))

    return F.flatten(F.array(*[one(k) for k in KINDS]))


def _bare() -> Column:
    """The text without the values of its entities."""
    longest_first = F.reverse(F.array_sort(F.array_distinct(F.transform("entities", lambda e: F.struct(F.length(e["value"]).alias("n"), e["value"].alias("value"))))))
    return F.aggregate(longest_first, F.col("text"), lambda t, v: F.replace(t, v["value"], F.lit(" ")))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _text_key() -> Column:
    return F.unhex(F.md5("text"))


def holders(based: DataFrame) -> DataFrame:
    """key, entities, terms, copies: the distinct texts that hold an entity, with their terms outside the entities' values."""
    held = based.withColumn("entities", _entities()).filter(F.size("entities") > 0)
    each = held.select(_text_key().alias("key"), F.struct(F.array_distinct("entities.entity").alias("entities"), _terms(_bare()).alias("terms")).alias("h"))
    return each.groupBy("key").agg(F.first("h").alias("h"), F.count("*").alias("copies")).select("key", "h.*", "copies")


def _same_texts() -> list[Column]:
    """What tells sets of texts apart: 128 bits over their keys."""
    return [F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")]


def screen(terms: DataFrame, column: str = "term"):
    """A test of columns that every term of ``terms`` passes, and few others while there are at most SCREEN_BITS / TERM_BITS."""
    size = 64
    most = terms.limit(SCREEN_BITS // TERM_BITS).count() * TERM_BITS
    while size < most:
        size *= 2
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int")
    at = terms.select(slot(F.col(column)).alias("slot"))
    word = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    rows = at.groupBy(F.expr("slot div 64").alias("w")).agg(F.bit_or(word).alias("bits")).collect()
    words = [0] * (size // 64)
    for r in rows:
        words[r["w"]] = r["bits"]
    bits = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    return lambda t: F.bit_get(F.get(bits, F.shiftright(slot(t), 6)), slot(t) % 64) == 1


def disclosing_terms(based: DataFrame, found: DataFrame, generalise: float = GENERALISE, left_out: int = LEFT_OUT) -> DataFrame:
    """term, disclosed: the terms that give away at least ``generalise`` of some entity's information, and the most they give.

    ``based`` are all documents with their base spans, ``found`` what ``holders`` makes of them. Probabilities
    are shares of documents, in which equal texts that hold entities are one. What stands within an entity's
    value is no term. Entities of the same texts share their counts, as do terms, so a page of many numbers
    and words makes one pair for each two sets of texts and not one for each number and word.
    """
    n = based.count() - (found.agg(F.sum(F.col("copies") - 1).alias("c")).first()["c"] or 0)
    p_e = F.col("n_e") / n
    # with more documents a term discloses less than ``generalise``, even if it is in all those of the entity
    most = (F.col("n_e") - left_out + SMOOTHING * p_e) / F.pow(p_e, F.lit(1 - generalise)) - SMOOTHING + left_out + 1e-6
    each = found.select("key", F.explode("entities").alias("entity"))
    # what no more texts hold is left with no evidence
    shared = each.groupBy("entity").agg(F.count("*").alias("n_e"), *_same_texts()).filter(F.col("n_e") > left_out)
    held = checkpoint(each.join(shared, "entity").select("key", "n_e", F.struct("x", "y").alias("e")).distinct())
    beside = found.join(held.groupBy("key").agg(F.max("n_e").alias("n_e")), "key").select("key", "n_e", F.explode("terms").alias("term"))
    seen = beside.groupBy("term").agg(F.count("*").alias("n_f"), F.max("n_e").alias("n_e"), *_same_texts())
    # a term is in no fewer documents than in those that hold entities
    rare = checkpoint(seen.filter((F.col("n_f") > left_out) & (F.col("n_f") <= most)).select("term", "n_e", F.struct("x", "y").alias("t")))
    hit = screen(rare)
    others = based.withColumn("entities", _entities()).filter(F.size("entities") == 0).select(F.explode(F.filter(_terms(F.col("text")), hit)).alias("term"))
    n_t = others.unionAll(found.select(F.explode(F.filter("terms", hit)).alias("term"))).groupBy("term").agg(F.count("*").alias("n_t"))
    rare = checkpoint(rare.join(n_t, "term").filter(F.col("n_t") <= most).select("term", "t", "n_t"))
    sets = found.select("key", F.explode(F.filter("terms", hit)).alias("term")).join(rare.select("term", "t"), "term").select("key", "t").distinct()
    pairs = sets.join(held, "key").groupBy("e", "t").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e")).filter(F.col("n_et") > left_out)
    p_et = (F.col("n_et") - left_out + SMOOTHING * p_e) / (F.col("n_t") - left_out + SMOOTHING)
    share = F.when(p_e < 1, 1 - F.log(p_et) / F.log(p_e)).otherwise(0.0)
    told = pairs.join(rare, "t").select("term", share.alias("disclosed")).groupBy("term").agg(F.max("disclosed").alias("disclosed"))
    return told.filter(F.col("disclosed") >= generalise)


def term_spans(based: DataFrame, terms: DataFrame) -> DataFrame:
    """key, term: for each distinct text that holds any of ``terms`` (term, disclosed) its spans (start, end, value, disclosed), in order."""
    hit = screen(terms)
    any_ = based.select("text").filter(F.exists(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda w: hit(F.lower(w))))
    tokens = any_.select(_text_key().alias("key"), F.explode(F.filter(find(F.col("text"), F.lit(TERM)), lambda s: hit(F.lower(s["value"])))).alias("s"))
    # equal texts have the same tokens: one of each goes on
    tokens = tokens.groupBy("key", "s").agg(F.lit(1).alias("one")).select("key", "s", F.lower("s.value").alias("term"))
    spans = tokens.join(terms, "term").select("key", F.struct("s.start", "s.end", "s.value", "disclosed").alias("s"))
    return spans.groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("term"))


def detect(docs: DataFrame, generalise: float = GENERALISE, left_out: int = LEFT_OUT) -> DataFrame:
    """Every document with its base spans by kind and the spans of disclosing terms.

    Returns doc_id, text, email, ip, card, phone and term, each an array of (start, end, value); those
    of ``term`` also hold what they disclose. A null text is empty. Repeated rows and equal texts are found
    alike, whatever their doc_id. Other columns are not looked at. An empty table gives none.
    """
    based = with_base(docs)
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,disclosed:double>>")
    found = checkpoint(holders(based))
    terms = checkpoint(disclosing_terms(based, found, generalise, left_out))
    if terms.isEmpty():
        return based.withColumn("term", none)
    out = based.withColumn("key", _text_key()).join(term_spans(based, terms), "key", "left").drop("key")
    return out.withColumn("term", F.coalesce("term", none))


def _sanitised(remove: float) -> Column:
    put = lambda s: F.when(s["disclosed"] >= remove, "").when(s["value"].rlike(r"^\p{N}"), "[NUMBER]").when(s["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(f"[{kind.upper()}]").alias("put")))

    each = [named(k) for k in KINDS]
    each.append(F.transform("term", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), put(s).alias("put"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def replaced(some: Column, at: Column) -> Column:
        """``some`` spans replaced in the piece of the text from ``at`` to their end."""
        end = F.greatest(at, F.array_max(F.transform(some, lambda s: -s["back"])))
        piece = F.substr("text", (at + 1).cast("int"), (end - at).cast("int"))
        step = lambda st, s: F.when(s["start"] < st["at"], st).otherwise(
            F.struct(F.concat(st["out"], F.substr(st["piece"], (st["at"] - st["from"] + 1).cast("int"), (s["start"] - st["at"]).cast("int")), s["put"]).alias("out"), (-s["back"]).alias("at"), st["piece"].alias("piece"), st["from"].alias("from"))
        )
        return F.aggregate(some, F.struct(F.lit("").alias("out"), at.alias("at"), piece.alias("piece"), at.alias("from")), step)

    def whole(spans: Column) -> Column:
        def block(state: Column, number: Column) -> Column:
            done = _let(F.slice(spans, number * BLOCK + 1, F.lit(BLOCK)), lambda some: replaced(some, state["at"]))
            return _let(done, lambda d: F.struct(F.concat(state["out"], d["out"]).alias("out"), d["at"].alias("at")))

        numbers = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int"))
        return F.when(F.size(spans) > 0, F.aggregate(numbers, start, block)).otherwise(start)

    done = _let(F.array_sort(F.flatten(F.array(*each))), whole)
    return _let(done, lambda d: F.concat(d["out"], F.substr("text", (d["at"] + 1).cast("int"), F.length("text"))))


def sanitise(found: DataFrame, remove: float = REMOVE) -> DataFrame:
    """doc_id and the text with entities replaced by their kind, disclosing terms generalised to
    [NUMBER], [NAME] or [WORD], and those that disclose ``remove`` or more taken out.

    Of spans that overlap the one that starts first, then the longer, is replaced. A text without spans stays."""
    return found.select("doc_id", _sanitised(remove).alias("sanitised"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, n_term, the number of spans of disclosing terms, and the digest of the sanitised
    text, of what ``detect`` found.

    A row for each of ``found``; one without spans has zeros, the digest of an empty string and empty spans.
    """


    def one(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    told = lambda kinds: F.array_join(F.flatten(F.array(*[one(k) for k in kinds])), ",")
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(told(KINDS), 256).alias("base_sha256"),
        told([*KINDS, "term"]).alias("spans"),
        F.size("term").cast("long").alias("n_term"),
        F.sha2(_sanitised(REMOVE), 256).alias("sanitised_sha256"),
    )

"""Personal data by information-theoretic sanitisation, with DataFrame functions only.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers that the base patterns find. Removing
them is not enough where other words of a document point to the same entity, so the corpus is asked how much a word
tells about one (c: entity, t: word, counted in documents, N of them):

* information of the entity   IC(c)    = ln(N / df(c))
* what the word tells of it   PMI(c;t) = ln(N * df(c, t) / (df(c) * df(t))), df(c, t): documents with t near c
* disclosure                  PMI / IC, 1 where the word is never seen without the entity.

In a document that holds c, every occurrence of a word whose disclosure of c reaches ``remove`` is removed, and of one
that reaches ``generalise`` is replaced by its class. ``near`` means within ``window`` code points of the entity, cut words
left out; a pair seen in fewer than ``support`` documents is no estimate. df(t) counts every document of the table.

Only entities are joined with the words of their windows (at most a window's words for each occurrence), never documents
with each other. Rows are told apart by their text, so copies are counted each but examined once; the join back to the
rows is salted, since copies of one text may be a third of them.

Defined results: a null text is empty and has no span; repeated rows and repeated ids give a row each, equal texts equal
spans; an empty table gives an empty result; columns beyond the id and the text are not read (``sanitise`` keeps them).
A span inside another kind's span is listed under both kinds; what a base pattern matches is never a word.

The patterns are the contract's, written so that Java's engine takes linear time and constant stack on any text: no
group is repeated with backtracking, and a match is tried only where a run begins or the last match ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.common import saved, table

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# the same matches as the contract's patterns (see the module's docstring); a card's needs its least number of digits
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}  # a text without it has no match
WORD = r"[\p{L}\p{N}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACES = "array<struct<start:int,end:int,value:string>>"
SEPARATOR = "\x01"  # in no entity and no word
SALTS = 16
BLOCK = 256  # matches that are placed one after the other


@dataclass(frozen=True)
class Config:
    window: int = 60  # code points on either side of an entity
    support: int = 2  # documents a pair must be seen in
    generalise: float = 0.85
    remove: float = 0.97


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for a row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def places(text: Column, found: Column, pattern: Column) -> Column:
    """Code point spans of the matches ``found`` of ``pattern``: lengths of the texts between them add up. Blocks of
    matches are placed apart and shifted by the lengths before them, so the work grows with the matches only."""
    gaps = F.filter(F.zip_with(F.split(text, pattern, -1), found, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value"))),
                    lambda x: x["value"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        begin, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    def place(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(PLACES).alias("out")), step, lambda acc: acc["out"])

    def offsets(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["value"])))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sums, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    cut = _bound(gaps, lambda g: F.transform(F.sequence(F.lit(1), F.size(g), F.lit(BLOCK)), lambda i: F.slice(g, i, BLOCK)))
    listed = _bound(cut, lambda blocks: F.flatten(F.zip_with(blocks, offsets(blocks), place)))
    return F.when(F.size(found) > 0, listed).otherwise(F.array().cast(PLACES))


def blanked(text: Column) -> Column:
    """The text, as long as before, with A-Z in lower case and blanks for whatever a base pattern matches."""
    pattern = F.lit("|".join(f"(?:{p})" for p in PATTERNS.values()))
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)),
                       lambda gap, value: F.concat(gap, F.repeat(F.lit(" "), F.coalesce(F.length(value), F.lit(0)))))
    return F.translate(F.array_join(parts, ""), UPPER, LOWER)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """One name for the ways that an entity is written in."""
    name = F.translate(value, UPPER, LOWER) if kind in ("email", "ip") else _digits(value)
    return F.concat(F.lit(f"{kind}:"), name)


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with an array of spans for each base kind."""
    for kind in KINDS:
        c = F.col(text)
        found = F.regexp_extract_all(c, F.lit(PATTERNS[kind]), F.lit(0))
        if kind in NEEDS:
            found = F.when(F.contains(c, F.lit(NEEDS[kind])), found)
        docs = docs.withColumn(f"__{kind}", F.coalesce(found, F.array().cast("array<string>")))
    for kind in KINDS:
        spans = places(F.col(text), F.col(f"__{kind}"), F.lit(PATTERNS[kind]))
        docs = docs.withColumn(f"__{kind}", _held(kind, spans))
    return docs


def _held(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _holds(kind, s["value"]))


def _named(kind: str) -> Column:
    return F.transform(f"__{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _entity(kind, s["value"]).alias("name")))


def _pairs(blank: Column, named: Column, cfg: Config) -> Column:
    """Distinct 'entity SEPARATOR word' of a text: the words within the window of each entity."""
    size = F.length(blank)

    def near(e: Column) -> Column:
        a, b = F.greatest(e["start"] - cfg.window, F.lit(0)), F.least(e["end"] + cfg.window, size)
        part = F.substring(blank, a + 1, b - a)
        words = places(part, F.regexp_extract_all(part, F.lit(WORD), F.lit(0)), F.lit(WORD))
        whole = F.filter(words, lambda w: ((w["start"] > 0) | (a == 0)) & ((w["end"] < b - a) | (b == size)))
        return F.transform(whole, lambda w: F.concat(e["name"], F.lit(SEPARATOR), w["value"]))

    return F.array_distinct(F.flatten(F.transform(named, near)))


def _base_rows(docs: DataFrame, cfg: Config, text_col: str, keep: list[str]) -> DataFrame:
    """Every row with its base spans, and where it holds an entity the entity names, the pairs and the blanked text."""
    docs = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    docs = with_base(docs, "__text")
    docs = docs.withColumn("__named", F.concat(*[_named(k) for k in KINDS]))
    some = F.size("__named") > 0
    docs = docs.withColumn("__blank", F.when(some, blanked(F.col("__text"))))
    return docs.select(
        *[f"k{i}" for i in range(len(keep))], *[f"__{k}" for k in KINDS],
        F.xxhash64("__text").alias("__h1"), F.xxhash64(F.lit(1), "__text").alias("__h2"),
        "__blank", F.when(some, F.array_distinct(F.transform("__named", lambda e: e["name"]))).alias("__names"),
        F.when(some, _pairs(F.col("__blank"), F.col("__named"), cfg)).alias("__pairs"))


def disclosures(docs: DataFrame, rows: DataFrame, cfg: Config, text_col: str) -> DataFrame:
    """``(entity, term, disclosure)`` of the pairs that reach ``generalise``; counts over all documents."""
    n = rows.agg(F.count(F.lit(1)).alias("n_docs"))
    entities = rows.select(F.explode("__names").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df_c"))
    pairs = rows.select(F.explode("__pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("df_ct")).where(F.col("df_ct") >= cfg.support)
    at = F.instr("pair", SEPARATOR)
    pairs = pairs.select(F.substring(F.col("pair"), F.lit(1), at - 1).alias("entity"), F.substring(F.col("pair"), at + 1, F.length("pair")).alias("term"), "df_ct")
    lowered = F.translate(F.col(f"`{text_col}`"), UPPER, LOWER)
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)))).alias("term"))
    terms = words.groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    told = pairs.join(entities, "entity").join(terms, "term").crossJoin(F.broadcast(n))  # n is one row
    pmi = F.ln(F.col("n_docs") * F.col("df_ct") / (F.col("df_c").cast("double") * F.col("df_t")))
    content = F.ln(F.col("n_docs").cast("double") / F.col("df_c"))
    # an entity in every document has no information left to disclose
    return told.where(content > 0).select("entity", "term", F.round(pmi / content, 9).alias("disclosure")).where(F.col("disclosure") >= cfg.generalise)


def _told_spans(rows: DataFrame, told: DataFrame) -> DataFrame:
    """``(__h1, __h2, __terms)``: spans of the telling words of each distinct text, with the largest disclosure."""
    texts = rows.where(F.col("__blank").isNotNull()).groupBy("__h1", "__h2").agg(F.first(F.struct("__blank", "__pairs")).alias("t"))
    pairs = texts.select("__h1", "__h2", F.explode("t.__pairs").alias("pair"))
    telling = told.select(F.concat("entity", F.lit(SEPARATOR), "term").alias("pair"), "term", "disclosure")
    # a text's words near its entities: bounded by the text
    mine = (pairs.join(telling, "pair").groupBy("__h1", "__h2", "term").agg(F.max("disclosure").alias("disclosure"))
            .groupBy("__h1", "__h2").agg(F.sort_array(F.collect_list(F.struct("term", "disclosure"))).alias("telling")))
    both = texts.join(mine, ["__h1", "__h2"]).select("__h1", "__h2", "t.__blank", "telling")
    # words hold letters and digits only, so they are their own patterns
    one_of = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform("telling", lambda t: t["term"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    both = both.withColumn("pattern", one_of).withColumn("found", F.regexp_extract_all("__blank", F.col("pattern"), F.lit(0)))
    spans = places(F.col("__blank"), F.col("found"), F.col("pattern"))
    values = F.map_from_entries("telling")
    return both.select("__h1", "__h2", F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.element_at(values, s["value"]).alias("disclosure"))).alias("__terms"))


def personal_data(docs: DataFrame, cfg: Config | None = None, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (all by default), ``email, ip, card, phone`` (spans with their values) and ``terms``
    (spans with their disclosure); one row for each row of ``docs``."""
    cfg = cfg or Config()
    keep = docs.columns if keep is None else keep
    rows = saved(_base_rows(docs, cfg, text_col, keep), "personal-data")
    found = _told_spans(rows, disclosures(docs, rows, cfg, text_col))
    salted = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = [*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"__{k}").alias(k) for k in KINDS]]
    none = F.array().cast("array<struct<start:int,end:int,disclosure:double>>")
    plain = rows.where(F.col("__blank").isNull()).select(*out, none.alias("terms"))
    held = rows.where(F.col("__blank").isNotNull()).drop("__blank", "__names", "__pairs").withColumn("__salt", F.floor(F.rand(1) * SALTS).cast("int"))
    held = held.join(salted, ["__h1", "__h2", "__salt"], "left").select(*out, F.coalesce("__terms", none).alias("terms"))
    return plain.unionByName(held)


def sanitise(docs: DataFrame, cfg: Config | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``sanitised``: base entities replaced by their kind in brackets, words that disclose one removed or
    replaced by their class (``[NUMBER]``, ``[NAME]`` with a capital, ``[WORD]``). Overlapping spans go as one. A null
    text stays null."""
    cfg = cfg or Config()
    renamed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text_col}`").alias("__body"))
    data = personal_data(renamed, cfg, ["__row", "__body"], "__body")
    body = F.col("__body")

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("tag")))

    def of_class(s: Column) -> Column:
        word = F.substring(body, s["start"] + 1, s["end"] - s["start"])
        general = F.when(word.rlike(r"^\p{N}+$"), "[NUMBER]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["disclosure"] >= cfg.remove, "").otherwise(general).alias("tag"))

    spans = F.array_sort(F.concat(*[tagged(k) for k in KINDS], F.transform("terms", of_class)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), s["tag"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    text = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    return data.select("__row.*", F.when(F.size(spans) > 0, text).otherwise(body).alias("sanitised"))


def _listed(kind: str, spans: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def op13_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.array_join(F.concat(*[_listed(k, k) for k in KINDS]), ",")
    spans = F.array_join(F.concat(*[_listed(k, k) for k in KINDS], _listed(TERM, "terms")), ",")
    return data.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                       F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))

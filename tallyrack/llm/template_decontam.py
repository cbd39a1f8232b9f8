r"""Benchmark decontamination by template windows.

Texts become templates.  Numbers, in digits or in English words, turn into a
typed placeholder; so do names, which are one to three capitalised words side
by side, but for words that often start a sentence; and units, which are unit words and
signs of currency or degree beside a number (``$5`` reads as ``5 $``).  The
rest is lower-cased and freed of marks.  Windows of ``WIDTH`` template words of
the benchmark are hashed and joined with those of the documents by hash; only
documents that hit are read again, and windows of equal hash are compared word
by word.

Items that differ in the values of their slots alone, with the same values
repeated at the same places, are one class, and a document is compared with
classes: a family of questions made from one template costs one row a
document.  Items with windows that count by value (below) have a class each.

Matches of a document and a class are grouped by their offset.  A group is an
occurrence of the question if its slots are consistent: each value of a
benchmark slot always stands for one value of the document, so questions with
new numbers or names are caught and chance meetings are not.  Occurrences are
pooled if they are consistent together, else the largest counts.  A document is
contaminated if ``least_windows`` of the item's windows are covered, or all if
it has fewer.

Windows of which fewer than half of the words have letters are weak: they count
where numbers, names and units are the same too, or in an occurrence that holds
``least_windows`` of the item's windows with words (or all) and two such words.
Windows without any word are only met with the same values.

Items with fewer than ``WIDTH`` words are one window of their own length; under
``SHORTEST`` words, or null, they are ignored.  Null and short documents match
nothing.  Items and documents may repeat; null ids are kept as null; private
characters that mark slots are taken out of texts first.  Other columns are
ignored by the report and carried by the filter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, written

WIDTH, SHORTEST = 8, 4
NUMBER, NAME, UNIT, JOIN, OPEN, CLOSE, WORD = map(chr, range(0xE000, 0xE007))
#: number words, unit words, and words that are no names where they are capitalised (fixed values)
NUMBERS = "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|dozen"
UNITS = "km|cm|mm|kg|mg|lbs|lb|oz|ml|mph|kmh|percent|pct|dollars|dollar|euros|euro|cents|cent|pounds|pound|miles|mile|meters|metres|meter|metre|inches|inch|feet|foot|liters|litres|liter|litre|grams|gram|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|degrees|degree|volts|watts|m|g|l|s|h|c|f"
STARTERS = (
    "The|A|An|In|On|At|By|For|From|With|To|Of|As|If|When|While|Where|What|Which|Who|Whom|Whose|Why|How|Is|Are|Was|Were|Be|Do|Does|Did|Has|Have|Had|Can|Could|Will|Would|Shall|Should|May|Might|Must|Not|No|Yes|And|Or|But|So|Then|Than|"
    "That|This|These|Those|There|Here|It|He|She|They|We|You|I|My|Your|His|Her|Its|Our|Their|Each|Every|All|Some|Any|Many|Much|More|Most|Both|Either|Neither|Let|Find|Compute|Calculate|Solve|Evaluate|Determine|Simplify|Estimate|Show|Prove|Given|"
    "Suppose|Consider|Assume|Write|Draw|Choose|Select|Answer|Explain|Describe|List|Name|Define|State|Identify|After|Before|During|Until|Since|Because|Although|However|Therefore|Thus|Also|Now|Next|First|Second|Third|Last|Finally|Once|Only|Even|Just"
)
SIGNS = r"\p{Sc}%°"
#: More benchmark windows, bytes of them, or candidate documents than this are joined by shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 18, 64 << 20

_PRIVATE = f"[{NUMBER}-{WORD}]"
_DIGITS = r"\p{N}+([.,:]\p{N}+)*"


def _one_of(words: str, any_case: bool = False) -> str:
    """Alternatives grouped by their first letter, so that most words are refused at it."""
    by: dict[str, list[str]] = {}
    for w in words.split("|"):
        by.setdefault(w[0], []).append(w[1:])
    head = lambda c: f"[{c}{c.upper()}]" if any_case else c
    return "(?:" + "|".join(f"{head(c)}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


def _possessive(run: str) -> str:
    """``run`` with its last group repeated without a way back: Java keeps a stack frame for each turn of a loop that it may have to undo, so long runs would overflow."""
    return f"{run}+"


# cheap refusals stand first: these read every character of the corpus
_IN_WORD = rf"\p{{L}}\p{{N}}{NUMBER}-{WORD}"
_RUN = rf"{_one_of(NUMBERS, True)}(?:[ -]{_one_of(NUMBERS, True)})*"
_NUMBER_WORD = rf"{_one_of(NUMBERS, True)}(?![{_IN_WORD}])"
_NUMBER_WORDS = rf"(?=[bdefhmnostzBDEFHMNOSTZ])(?<![a-z])(?<![{_IN_WORD}]){_NUMBER_WORD}(?:[ -]{_NUMBER_WORD})*+"
_STARTERS = rf"(?=[A-Z])(?<!\p{{L}}){_one_of(STARTERS)}(?!\p{{L}})"
_NAME_RUN = r"\p{Lu}\p{Ll}\p{L}*(?: \p{Lu}\p{Ll}\p{L}*)*"
_NAMES = rf"(?=\p{{Lu}})(?<![\p{{L}}{WORD}]){_possessive(_NAME_RUN)}"
_LONG = rf"{OPEN}((?:[^ {CLOSE}]+ ){{3,}}[^{CLOSE}]*){CLOSE}"
_LONG_NAME = rf"{OPEN}((?:[^ {CLOSE}]+ ){{3}}[^{CLOSE}]*){CLOSE}"
_UNITS = rf"([{SIGNS}]) ?{NUMBER}|{NUMBER} ?(?:({UNITS})([^\p{{L}}\p{{N}}]|$)|([{SIGNS}]))"
_MARKS = rf"[^a-z\s\p{{L}}\p{{N}}{SIGNS}{NUMBER}-{JOIN}]+"


def template(text: Column) -> Column:
    """The template's words."""
    t = F.regexp_replace(F.regexp_replace(text, _PRIVATE, ""), _possessive(_DIGITS), NUMBER)
    t = F.regexp_replace(F.regexp_replace(t, _NUMBER_WORDS, WORD), f"{NUMBER}[ -]{WORD}|{WORD}", NUMBER)
    t = _tag_names(t)
    t = F.lower(F.regexp_replace(t, f"{OPEN}[^{CLOSE}]*{CLOSE}", NAME))
    return _words(F.regexp_replace(t, _UNITS, f"{NUMBER} {UNIT}$3"))


def _tag_names(text: Column) -> Column:
    """Names between OPEN and CLOSE; WORD shields what only starts a sentence, and goes with the marks."""
    shielded = F.regexp_replace(text, _STARTERS, f"{WORD}$0")
    return F.regexp_replace(F.regexp_replace(shielded, _NAMES, f"{OPEN}$0{CLOSE}"), _LONG_NAME, "$1")


def literal(text: Column) -> Column:
    """The words of ``text`` in place of the template's placeholders, one for one."""
    tagged = lambda kind: f"{OPEN}{kind}{CLOSE}"
    t = F.regexp_replace(F.regexp_replace(text, _PRIVATE, ""), _possessive(_DIGITS), tagged("$0"))
    t = F.regexp_replace(F.regexp_replace(t, _NUMBER_WORDS, tagged("$0")), rf"{CLOSE}[ -]{OPEN}(\p{{L}})", f"{JOIN}$1")
    values = F.transform(F.regexp_extract_all(t, F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), 1), lambda v: F.regexp_replace(v, "[ -]", JOIN))
    t = F.regexp_replace(t, f"{OPEN}[^{CLOSE}]*{CLOSE}", NUMBER)
    t = _tag_names(t)
    for _ in range(2):  # names have three words at most
        t = F.regexp_replace(t, f"{OPEN}([^ {CLOSE}]+) ([^{CLOSE}]*){CLOSE}", f"{OPEN}$1{JOIN}$2{CLOSE}")
    t = F.regexp_replace(F.lower(F.regexp_replace(t, f"[{OPEN}{CLOSE}]", "")), _UNITS, f"{NUMBER} $1$2$4$3")
    return _words(F.array_join(F.zip_with(F.split(t, NUMBER), F.transform(values, F.lower), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(text, _MARKS, ""), r"\s+"), "")


def _is_slot(word: Column) -> Column:
    return word.rlike(f"[{NUMBER}-{UNIT}]")


def _has_letters(word: Column) -> Column:
    return word.rlike(r"\p{L}")


def _key(words: str, literals: str) -> Column:
    """What windows meet by: the template, or the values if it is all placeholders."""
    return F.when(F.exists(words, _has_letters), F.xxhash64(words)).otherwise(F.xxhash64(literals))


def _slots(words: str, values: str, more: str | None = None) -> Column:
    """kind and value (and the value in ``more``) of the slots among ``words``."""
    fields = lambda t, i: F.struct(t.alias("kind"), F.get(values, i).alias("item_value"), *([F.get(more, i).alias("doc_value")] if more else []))
    return F.filter(F.transform(words, fields), lambda s: _is_slot(s["kind"]))


def _consistent(slots: Column) -> Column:
    return F.size(slots) == F.size(F.array_distinct(F.transform(slots, lambda s: F.struct(s["kind"], s["item_value"]))))


def _window_hashes(words: Column, width: int) -> Column:
    full = F.size(words) - (width - 1)
    return F.when(full > 0, F.slice(F.transform(words, lambda _, i: F.xxhash64(F.slice(words, i + 1, width))), F.lit(1), full)).otherwise(F.array().cast("array<bigint>"))


def _weak(words: Column) -> Column:
    return 2 * F.size(F.filter(words, _has_letters)) < F.size(words)


def item_classes(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, class, words, values, width of every benchmark item that has a window; its class is what documents are compared with."""
    text = F.col(quoted(text_col)).cast("string")
    base = items.where(text.isNotNull()).select(F.col(quoted(item_col)).alias("item"), template(text).alias("words"), literal(text).alias("values")).where(F.size("words") >= SHORTEST).distinct()
    base = base.withColumn("width", F.least(F.size("words"), F.lit(WIDTH)))
    slots = _slots("words", "values")
    pattern = F.transform(slots, lambda s: F.array_position(slots, s))
    weak = F.exists(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1), lambda i: _weak(F.slice("words", i, F.col("width"))))
    return base.withColumn("class", F.xxhash64("words", pattern, F.when(weak, F.col("values"))))


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """class, item, items, width, at, hash, key, lettered, n_windows, n_worded, words, literals of every window of every class.

    item is the least id of the class, whose values stand for it; items is their number.
    """
    lead = F.min(F.struct(F.col("item").isNull().alias("absent"), "item", "words", "values", "width")).alias("lead")
    base = item_classes(items, item_col, text_col).groupBy("class").agg(lead, F.count("*").alias("items"))
    base = base.select("class", "items", "lead.item", "lead.width", F.col("lead.words").alias("t"), F.col("lead.values").alias("w"))
    windows = F.transform(F.sequence(F.lit(1), F.size("t") - F.col("width") + 1), lambda i: F.struct((i - 1).alias("at"), F.slice("t", i, F.col("width")).alias("words"), F.slice("w", i, F.col("width")).alias("literals")))
    worded = F.size(F.filter(windows, lambda x: F.exists(x["words"], _has_letters)))
    rows = base.select("class", "item", "items", "width", F.size(windows).alias("n_windows"), worded.alias("n_worded"), F.explode(windows).alias("x")).select("*", "x.*").drop("x")
    return rows.withColumn("lettered", F.size(F.filter("words", _has_letters))).withColumn("hash", F.xxhash64("words")).withColumn("key", _key("words", "literals"))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_windows: int = 6) -> DataFrame:
    """doc_id, text_hash, item_id, items, matched_windows, item_windows, slots, changed_slots of documents and the classes that contaminate them.

    item_id is the least id of the class, items the number of its members.
    Rows of equal id and text count once.
    """
    windows = written(item_windows(items), "decontam-windows")
    size = F.sum(F.octet_length(F.array_join(F.concat("words", "literals"), "")) + 100)
    widths = {r["width"]: (r["n"], r["size"]) for r in windows.groupBy("width").agg(F.count("*").alias("n"), size.alias("size")).collect()}
    small = sum(n for n, _ in widths.values()) <= BROADCAST_ROWS and sum(s for _, s in widths.values()) <= BROADCAST_BYTES
    text = F.col(quoted(text_col)).cast("string")
    rows = docs.where(text.isNotNull()).select(F.col(quoted(id_col)).alias("doc_id"), text.alias("text"))
    hashed = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), template(F.col("text")).alias("t"))
    keys = windows.select("width", "hash").distinct()
    hits = None
    for width in sorted(widths) or [WIDTH]:
        one = hashed.select("doc_id", "text_hash", F.lit(width).alias("width"), F.posexplode(_window_hashes(F.col("t"), width)).alias("pos", "hash"))
        hits = one if hits is None else hits.unionByName(one)
    if len(widths) > 1:  # one template for all widths
        every = F.flatten(F.array(*[F.transform(_window_hashes(F.col("t"), w), lambda h, i, w=w: F.struct(F.lit(w).alias("width"), i.alias("pos"), h.alias("hash"))) for w in sorted(widths)]))
        hits = hashed.select("doc_id", "text_hash", F.explode(every).alias("x")).select("doc_id", "text_hash", "x.*")
    hits = written(hits.join(F.broadcast(keys) if small else keys, ["width", "hash"]), "decontam-hits").distinct()
    near = written(hits.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")).distinct(), "decontam-near")
    if near.count() <= BROADCAST_ROWS:
        near = F.broadcast(near)
    texts = rows.join(near, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.xxhash64("text") == F.col("own_hash"))).dropDuplicates(["own_id", "own_hash"])
    texts = texts.select("own_id", "own_hash", template(F.col("text")).alias("t"), literal(F.col("text")).alias("w"))
    found = hits.join(texts, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))).select(
        "doc_id", "text_hash", "width", "pos", F.slice("t", F.col("pos") + 1, F.col("width")).alias("dt"), F.slice("w", F.col("pos") + 1, F.col("width")).alias("dw"))
    found = found.withColumn("key", _key("dt", "dw"))
    met = found.join(F.broadcast(windows) if small else windows, ["width", "key"]).where("dt = words AND (lettered > 0 OR dw = literals)")
    spots = F.filter(F.transform("words", lambda t, i: F.when(_has_letters(t), F.col("at") + i)), lambda x: x.isNotNull())
    plain = 2 * F.col("lettered") >= F.col("width")
    exact = ~plain & (F.col("dw") == F.col("literals"))
    merged = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    group = met.withColumn("slots", _slots("dt", "literals", "dw")).groupBy("doc_id", "text_hash", "class", (F.col("pos") - F.col("at")).alias("offset")).agg(
        F.collect_set("at").alias("ats"), F.collect_set(F.when(plain, F.col("at"))).alias("plain_ats"), F.collect_set(F.when(exact, F.col("at"))).alias("exact_ats"),
        merged("slots").alias("slots"), merged(F.when(plain, F.col("slots"))).alias("plain_slots"), merged(F.when(exact, F.col("slots"))).alias("exact_slots"),
        F.size(F.collect_set(F.when(F.col("lettered") > 0, F.col("at")))).alias("worded"), F.size(merged(spots)).alias("spots"),
        F.max("n_windows").alias("item_windows"), F.max("n_worded").alias("n_worded"), F.max("item").alias("item"), F.max("items").alias("items"))
    whole = _consistent(F.col("slots")) & (F.col("worded") >= F.least(F.col("n_worded"), F.lit(least_windows))) & (F.col("spots") >= 2)
    fits = _consistent(F.col("plain_slots"))
    counted = lambda c: F.when(whole, F.col(c)).otherwise(F.when(fits, F.array_union(f"plain_{c}", f"exact_{c}")).otherwise(F.col(f"exact_{c}"))).alias(c)
    group = group.select("doc_id", "text_hash", "class", "item", "items", "item_windows", "offset", whole.alias("whole"), counted("ats"), counted("slots")).where(F.size("ats") > 0)
    largest = F.max(F.struct(F.size("ats").alias("n"), (-F.col("offset")).alias("first"), "slots")).alias("largest")
    pairs = group.groupBy("doc_id", "text_hash", "class").agg(
        F.size(merged("ats")).alias("pooled"), merged("slots").alias("slots"), largest, F.max("item_windows").alias("item_windows"), F.max("whole").alias("whole"), F.max("item").alias("item"), F.max("items").alias("items"))
    together = _consistent(F.col("slots"))
    pairs = pairs.withColumn("matched", F.when(together, F.col("pooled")).otherwise(F.col("largest.n"))).withColumn("slots", F.when(together, F.col("slots")).otherwise(F.col("largest.slots")))
    changed = F.size(F.filter("slots", lambda s: s["item_value"] != s["doc_value"]))
    return pairs.where(F.col("whole") | (F.col("matched") >= F.least(F.col("item_windows"), F.lit(least_windows)))).select(
        "doc_id", "text_hash", F.col("item").alias("item_id"), "items", F.col("matched").cast("long").alias("matched_windows"), F.col("item_windows").cast("long").alias("item_windows"),
        F.size("slots").cast("long").alias("slots"), changed.cast("long").alias("changed_slots"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept."""
    bad = matches(docs, items, id_col, text_col).select("doc_id", "text_hash").distinct()
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(quoted(id_col)).alias("own_id"), F.xxhash64(F.col(quoted(text_col)).cast("string")).alias("own_hash"))
    return rows.join(bad, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")), "left_anti").select("row.*")


def op1_template_decontam(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return matches(docs.select("doc_id", "text"), items).drop("text_hash")


def _sql() -> str:
    """The same in DuckDB, where benchmark texts have letters enough that no window is weak.

    Its expressions can't look around, so a pass that needs its neighbours runs twice.
    """
    def rr(value: str, pattern: str, by: str) -> str:
        return f"regexp_replace({value}, '{pattern}', '{by}', 'g')"

    tags = f"{OPEN}[^{CLOSE}]*{CLOSE}"
    slot = f"[{NUMBER}-{UNIT}]"
    words = lambda x: f"regexp_extract_all({rr(x, _MARKS, '')}, '[^\\s]+')"
    twice = lambda x, pattern, by: rr(rr(x, pattern, by), pattern, by)
    names = lambda x: rr(rr(twice(x, rf"(^|[^\p{{L}}])({STARTERS})([^\p{{L}}]|$)", rf"\1{WORD}\2\3"), rf"(^|[^\p{{L}}{WORD}])({_NAME_RUN})", rf"\1{OPEN}\2{CLOSE}"), _LONG, r"\1")
    join_names = f"{OPEN}([^ {CLOSE}]+) ([^{CLOSE}]*){CLOSE}"
    joined = rf"{OPEN}\1{JOIN}\2{CLOSE}"
    values = f"[lower({rr('v', '[ -]', JOIN)}) FOR v IN regexp_extract_all(n1, '{OPEN}([^{CLOSE}]*){CLOSE}', 1)]"
    return rf"""
WITH raw AS (SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE text IS NOT NULL),
a AS (SELECT side, id, {twice(rr(rr("text", _PRIVATE, ""), _DIGITS, rf"{OPEN}\0{CLOSE}"), rf"(^|[^{_IN_WORD}])({_RUN})([^{_IN_WORD}]|$)", rf"\1{OPEN}\2{CLOSE}\3")} AS n0 FROM raw),
b AS (SELECT side, id, {rr("n0", rf"{CLOSE}[ -]{OPEN}(\p{{L}})", rf"{JOIN}\1")} AS n1 FROM a),
c AS (SELECT *, {values} AS vals, {names(rr("n1", tags, NUMBER))} AS tagged FROM b),
e AS (SELECT side, id, vals, {rr(f"lower({rr('tagged', tags, NAME)})", _UNITS, rf"{NUMBER} {UNIT}\3")} AS t0,
             string_split({rr("lower(" + rr(rr(rr("tagged", join_names, joined), join_names, joined), f"[{OPEN}{CLOSE}]", "") + ")", _UNITS, rf"{NUMBER} \1\2\4\3")}, '{NUMBER}') AS bits FROM c),
f AS (SELECT side, id, {words("t0")} AS t, {words("array_to_string([bits[i] || coalesce(vals[i], '') FOR i IN range(1, len(bits) + 1)], '')")} AS w FROM e),
g AS (SELECT DISTINCT id, t, w, least(len(t), {WIDTH}) AS width, [{{'k': t[i], 'v': w[i]}} FOR i IN range(1, len(t) + 1) IF regexp_matches(t[i], '{slot}')] AS s FROM f WHERE side = 'b' AND len(t) >= {SHORTEST}),
items AS (SELECT t, width, min(id) AS item_id, count(*) AS items, arg_min(w, id) AS w, row_number() OVER () AS cls FROM g GROUP BY t, width, [list_position(s, x) FOR x IN s]),
iw AS (SELECT cls, item_id, items, width, len(t) - width + 1 AS item_windows, p - 1 AS spot, t[p:p+width-1] AS words, w[p:p+width-1] AS lits FROM (SELECT *, unnest(range(1, len(t) - width + 2)) AS p FROM items)),
dw AS (SELECT id AS doc_id, width, p - 1 AS pos, t[p:p+width-1] AS words, w[p:p+width-1] AS lits
       FROM (SELECT f.*, width, unnest(range(1, greatest(len(t) - width + 2, 1))) AS p FROM f, (SELECT DISTINCT width FROM items) WHERE side = 'd')),
met AS (SELECT doc_id, cls, item_id, items, pos - spot AS off, spot, item_windows,
               [{{'k': dw.words[i], 'a': iw.lits[i], 'b': dw.lits[i]}} FOR i IN range(1, dw.width + 1) IF regexp_matches(dw.words[i], '{slot}')] AS slots
        FROM dw JOIN iw USING (width, words)),
grp AS (SELECT doc_id, cls, item_id, items, item_windows, off, list(DISTINCT spot) AS ats, list_distinct(flatten(list(slots))) AS slots FROM met GROUP BY doc_id, cls, item_id, items, item_windows, off),
good AS (SELECT * FROM grp WHERE len(slots) = len(list_distinct([{{'k': s.k, 'a': s.a}} FOR s IN slots]))),
pooled AS (SELECT doc_id, cls, item_id, items, item_windows, len(list_distinct(flatten(list(ats)))) AS n_all, list_distinct(flatten(list(slots))) AS all_slots, max(len(ats)) AS n_one, arg_max(slots, len(ats) * 1000000000 - off) AS one_slots
           FROM good GROUP BY doc_id, cls, item_id, items, item_windows),
pick AS (SELECT *, len(all_slots) = len(list_distinct([{{'k': s.k, 'a': s.a}} FOR s IN all_slots])) AS fits FROM pooled),
best AS (SELECT doc_id, item_id, items, item_windows, CASE WHEN fits THEN n_all ELSE n_one END AS matched, CASE WHEN fits THEN all_slots ELSE one_slots END AS slots FROM pick)
SELECT doc_id, item_id, items::BIGINT AS items, matched::BIGINT AS matched_windows, item_windows::BIGINT AS item_windows, len(slots)::BIGINT AS slots, len([s FOR s IN slots IF s.a <> s.b])::BIGINT AS changed_slots
FROM best WHERE matched >= least(item_windows, 6)
"""


SQL = _sql()

"""Benchmark decontamination by templates.  DataFrame functions only.

A text's words become typed tokens: #n for a number (a unit may stick to it), #u for a unit behind a number, #p for a
name (capitalised inside a sentence), else the word in lower case; signs at a word's ends go.  Benchmark items and
documents are joined on the hash of every `width`-token window of these templates.  Along the windows that match, each
value that stands in a slot of the item must be replaced by one value only, so a question asked anew with other numbers
or names is caught, and texts that merely share a shape are not.  That is asked of the document as a whole, of each
alignment and of each ascending run of windows: one occurrence that holds is enough, whatever stands elsewhere.

A window has up to three keys: by its template, by its template with the names at the beginning of sentences as names
too, and by its words, which finds it as it is wherever it stands and however few of its tokens are literal.

Templates are dear and few documents hold an item, so documents are screened first: whatever the key, a window that
matches has the same literal words in the same places.  Of each key's window four of them are taken, as close together as
there are, and a document goes on only if four of its words stand like that; none that matches is lost.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_columns, read_table, settle

#: Tokens of a window, share of an item's windows that must match, literal words that a window must have.
WIDTH, SHARE, LITERAL = 8, 0.5, 4
#: Bits of a prefilter for each of its keys, and at most (it is a literal of the plan); window rows up to which the benchmark is broadcast.
BITS, MOST_BITS, BROADCAST_ROWS = 64, 1 << 21, 200_000
#: Literal words of a window that the screen looks for: as many as a window of literals enough has.
PROBE = LITERAL
#: Tokens whose hash tells at once that most windows are in no item.
HEAD = 2
#: Units that are placeholders behind a number.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz t ml cl l gal s sec min h hr hrs day days week weeks month months year years ms mph kmh kph w kw mw v a hz khz mhz ghz b kb mb gb tb cal kcal j kj pa kpa bar k c f degrees percent % usd eur gbp dollars euros pounds cents meters metres miles inches feet hours minutes seconds grams kilograms liters litres".split()
#: Signs that go at a word's ends, as a character class.
EDGES = r"[!-#&-*,\-.:-@\[\]^-`{-~\u00A1\u00AB\u00BB\u00BF\u2018\u2019\u201C\u201D\u2026]"
#: A capitalised word (not one all in capitals) behind a word that doesn't end a sentence; a word that begins with a number.
NAME = r"\p{Lu}(?<=[^\s.!?:]\s{1,3}[\"'(\[]{0,2}\p{Lu})(?!\p{Lu}+[^\p{Ll}\s]*(?:\s|$))\S*"
ANY_NAME = NAME.replace(r"[^\s.!?:]\s{1,3}", r"(?:^|\s)")
NUMBER = r"(?=[-+$\u20AC\u00A3\"'(\[0-9])(?<!\S)[-+$\u20AC\u00A3\"'(\[]{0,3}[0-9]\S*"
FIRST = "\ue003"  # stands before a capitalised word at the beginning of a sentence
MARKS = ("\ue000", "\ue001", "\ue002")  # stand for #n, #u, #p, so that the signs at the ends of words can go


def _bare(text: Column) -> Column:
    """The text in lower case, without the signs at the ends of words."""
    # the class comes first and the look-around after it, so that letters are passed over quickly
    return F.regexp_replace(F.lower(text), f"{EDGES}+(?:(?!\\S)|(?<=(?:^|\\s){EDGES}{{1,16}}))", "")


def _split(bare: Column) -> Column:
    return F.array_remove(F.split(bare, "\\s+"), "")


def _words(text: Column) -> Column:
    """Words without the signs at their ends, in lower case."""
    return _split(_bare(text))


def _marked(text: Column) -> Column:
    """The typed tokens of a text, with FIRST before what may be a name or not.  Each stands for one word of _words(), in the same place."""
    number, unit, name = MARKS
    units = "|".join(sorted((u.replace("%", "\\%") for u in UNITS), key=len, reverse=True))
    typed = F.regexp_replace(F.regexp_replace(text, NAME, name), ANY_NAME, f"{FIRST}$0")
    typed = F.regexp_replace(typed, NUMBER, number)
    return _bare(F.regexp_replace(typed, f"{number}(\\s+)(?i:{units})(?!\\p{{L}})\\S*", f"{number}$1{unit}"))


def template(marked: Column) -> Column:
    return _split(F.translate(marked, FIRST, ""))


def loose_template(marked: Column) -> Column:
    """As template(), with every capitalised word as a name."""
    return _split(F.regexp_replace(marked, f"{FIRST}\\S*", MARKS[2]))


def window_keys(tokens: Column, width: int, likely=None) -> Column:
    """The key of each window in order; none if there are fewer tokens than width.

    likely: a condition on the hash of a window's first tokens (HEAD of them at most); where it doesn't hold, the key is null.
    """
    starts = F.when(F.size(tokens) >= width, F.sequence(F.lit(0), F.size(tokens) - width)).otherwise(F.array().cast("array<int>"))

    def key(i: Column) -> Column:
        whole = F.xxhash64(*(F.get(tokens, i + j) for j in range(width)))
        return whole if likely is None else F.when(likely(F.xxhash64(*(F.get(tokens, i + j) for j in range(min(HEAD, width))))), whole)

    return F.transform(starts, key)


def _literal_enough(tokens: Column, width: int) -> Column:
    return F.size(F.filter(tokens, lambda t: ~t.isin(*MARKS))) >= min(LITERAL, width)


def _forms(texts: DataFrame, *names: str) -> DataFrame:
    """The named columns and the three token arrays of each text: tokens, loose, words."""
    marked = texts.withColumn("marked", _marked(F.col("text")))
    return marked.select(*names, template(F.col("marked")).alias("tokens"), loose_template(F.col("marked")).alias("loose"), _words(F.col("text")).alias("words"))


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item, item_id, width, i, key, kinds and values (the window's tokens and words) of each form of a window; marks (kinds with the slots to compare), as_name
    (names at the beginning of sentences count), rich (the template has literals enough), n and n_rich (windows of the item, and those that are rich).

    An item shorter than width is one window; one without tokens has none.  A window that isn't rich has its words as its only form.
    Texts are items of their own (item: a hash of id and text): an item without an id counts, two texts under one id are two, rows that repeat both are one.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    items = items.withColumn("item", F.md5(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "text")))
    items = _forms(items, "item", "item_id").where(F.size("tokens") > 0)
    items = items.withColumn("width", F.least(F.size("tokens"), F.lit(width)))
    sizes = sorted(r["width"] for r in items.select("width").distinct().collect()) or [width]
    found = None
    for w in sizes:
        cut = lambda name: F.slice(name, F.col("i") + 1, w)  # noqa: B023, E731
        part = items.where(F.col("width") == w).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("tokens") - w)))
        part = part.select("item", "item_id", "width", "i", cut("tokens").alias("tokens"), cut("loose").alias("loose"), cut("words").alias("values"))
        part = part.withColumn("rich", _literal_enough(F.col("tokens"), w))
        form = lambda kinds, marks, as_name: F.struct(F.get(window_keys(F.col(kinds), w), F.lit(0)).alias("key"), F.col(kinds).alias("kinds"), F.col(marks).alias("marks"), F.lit(as_name).alias("as_name"))  # noqa: B023, E731
        forms = F.array(F.when(F.col("rich"), form("tokens", "tokens", False)), F.when(_literal_enough(F.col("loose"), w) & (F.col("loose") != F.col("tokens")), form("loose", "loose", True)), F.when(~F.col("rich") | (F.col("values") != F.col("tokens")), form("values", "tokens", False)))
        part = part.withColumn("f", F.explode(F.array_compact(forms))).select("item", "item_id", "width", "i", "f.*", "values", "rich")
        found = part if found is None else found.unionByName(part)
    sums = found.groupBy("item").agg(F.count_distinct("i").alias("n"), F.count_distinct(F.when(F.col("rich"), F.col("i"))).alias("n_rich"))
    return found.join(sums, "item")


def _known(keys: DataFrame, bits: int = BITS):
    """A condition on a key (a long) that holds for all of keys and few others: a bit for each, in a literal of the plan."""
    keys = keys.select("key").distinct()
    size = min(MOST_BITS, 1 << max(12, (bits * keys.count() - 1).bit_length()))
    at = F.col("key").bitwiseAND(F.lit(size - 1).cast("long"))
    words = [0] * (size // 64)
    filled = keys.select(F.shiftright(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int")).alias("x"))
    for r in filled.groupBy("w").agg(F.bit_or("x").alias("x")).collect():  # MOST_BITS / 64 rows at most
        words[r["w"]] = r["x"]
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to a literal

    def holds(key: Column) -> Column:
        # an array of one binds the key to a variable: it is used twice, and expressions in array functions are not shared
        low = lambda k, n: k.bitwiseAND(F.lit(n).cast("long")).cast("int")
        return F.exists(F.array(key), lambda k: F.getbit(F.get(table, F.shiftright(low(k, size - 1), 6)), low(k, 63)) == 1)

    return holds


def probes(items: DataFrame) -> DataFrame:
    """Of each row of item_windows(), PROBE literal words of its window: steps (places of the others behind the first, or before it),
    and keys (hashes of the first two, the first three and so on, with their steps).

    They are neighbours among the literal words.  The first two stand next to each other if any two do, then the group
    is the closest there is.  Of a window with fewer literal words the last is taken again.
    """
    places = F.filter(F.sequence(F.lit(0), F.size("kinds") - 1), lambda j: ~F.get("kinds", j).isin(*MARKS))
    at = lambda j: F.get("p", F.least(j, F.size("p") - 1))

    def group(j: Column, pair: int) -> Column:
        others = [n for n in range(PROBE) if n not in (pair, pair + 1)]
        near, first = at(j + pair + 1) - at(j + pair), at(j + pair)
        steps = F.array(near, *(at(j + n) - first for n in others))
        return F.struct((near == 0).alias("same"), near.alias("near"), (at(j + PROBE - 1) - at(j)).alias("span"), F.lit(pair).alias("pair"), first.alias("first"), steps.alias("steps"))

    groups = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size("p") - PROBE, F.lit(0))), lambda j: F.array(*(group(j, m) for m in range(PROBE - 1)))))
    rows = items.select("kinds", places.alias("p")).withColumn("g", F.array_min(groups)).select("kinds", "g.first", "g.steps")
    return rows.select("steps", F.array(*(_probe_key(F.col("kinds"), F.col("first"), [F.get("steps", F.lit(n)) for n in range(m)]) for m in range(1, PROBE))).alias("keys")).distinct()


def _probe_key(words: Column, first: Column, steps: list[Column]) -> Column:
    return F.xxhash64(F.get(words, first), *(F.get(words, first + s) for s in steps), *steps)


def screen(words: Column, wanted: DataFrame) -> Column:
    """Whether some of the words stand like one of the probes: false only if no window of theirs can match.

    The commonest shape (steps) has tables of its own, so that the others' stay nearly empty.
    """
    counts = {tuple(r["steps"]): r["count"] for r in wanted.groupBy("steps").count().collect()}  # 2 * WIDTH to the power of PROBE - 1 at most
    if not counts:
        return F.lit(False)
    common, *others = sorted(counts, key=lambda s: (-counts[s], s))
    is_common = F.col("steps") == F.array(*map(F.lit, common))
    tables = lambda rows: [_known(rows.select(F.get("keys", F.lit(m)).alias("key")), 4 * BITS if m else BITS) for m in range(PROBE - 1)]
    parts = [([common], tables(wanted.where(is_common)))] + ([(others, tables(wanted.where(~is_common)))] if others else [])

    def stands(w: Column, i: Column, shapes: list[tuple[int, ...]], known: list, n: int = 0) -> Column:
        """Whether one of the shapes, which begin alike up to n steps, stands at i; one word more at a time."""
        found = F.lit(False)
        for steps in sorted({s[: n + 1] for s in shapes}):
            here = known[n](_probe_key(w, i, [F.lit(x) for x in steps]))
            found = found | (here if n == PROBE - 2 else here & stands(w, i, [s for s in shapes if s[: n + 1] == steps], known, n + 1))
        return found

    any_stands = lambda w, i: reduce(or_, (stands(w, i, *part) for part in parts))
    # an array of one binds the words to a variable: a filter would compute them anew at each place
    return F.exists(F.array(words), lambda w: (F.size(w) > 0) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), lambda i: any_stands(w, i)))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, n_slots, verbatim of each item that a document holds.

    An item is held if at least `share` of its windows stand in the document as they are (verbatim), or if as many match
    and no value in a slot of those windows stands for two values, in the document or in one occurrence of it.  n_slots counts the item's different
    slot values in the windows that match.  Null and empty texts match nothing; rows that repeat a doc_id count as one document; rows
    without a doc_id are reported under null; an item without an item_id is reported under null, and two texts under one item_id are items of
    their own, a row each; an empty table gives an empty table.
    """
    items = settle(item_windows(benchmark, width), "items")
    n = items.count()
    sizes = [r["width"] for r in items.select("width").distinct().collect()]
    known = _known(items)
    likely = _known(items.select(F.when(F.col("width") >= HEAD, F.xxhash64(*(F.get("kinds", F.lit(j)) for j in range(HEAD)))).otherwise(F.col("key")).alias("key")))

    rows = doc_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    some_rows = rows.where(screen(_words(F.col("text")), settle(probes(items), "probes")))
    # stored in two steps: in one, the templates' expressions slow the screen down
    tokens = settle(_forms(settle(some_rows, "screened"), "doc_id", "text"), "forms") if sizes else None
    found = None
    for w in sorted(sizes):
        some = lambda name: F.array_compact(F.transform(window_keys(F.col(name), w, likely), lambda x, i: F.when(x.isNotNull() & known(x), F.struct(i.alias("i"), x.alias("key")))))  # noqa: B023, E731
        hits = tokens.select("doc_id", F.xxhash64("text").alias("text"), *("tokens", "loose", "words"), *(some(name).alias(f"by_{name}") for name in ("tokens", "loose", "words")))
        own = lambda name: F.transform(f"by_{name}", lambda x: F.struct(x["key"].alias("key"), x["i"].alias("at"), F.slice(F.col(name), x["i"] + 1, w).alias("own_kinds"), F.slice(F.col("words"), x["i"] + 1, w).alias("own_values")))  # noqa: B023, E731
        hits = hits.select("doc_id", "text", F.array_distinct(F.concat(own("tokens"), own("loose"), own("words"))).alias("hits"))
        # what was found is stored: a filter would compute it anew
        part = settle(hits, "hits").select("doc_id", "text", F.explode("hits").alias("h")).select("doc_id", "text", "h.*", F.lit(w).alias("width"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_matched"), F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("n_slots"), F.lit(True).alias("verbatim")).where(F.lit(False))
    small = F.broadcast(items) if n <= BROADCAST_ROWS else items
    matched = found.join(small, ["key", "width"]).where("own_kinds = kinds")
    pairs = F.filter(F.arrays_zip("marks", "values", "own_values"), lambda p: p["marks"].isin(*MARKS))
    matched = matched.select("doc_id", "item", "item_id", "n", "n_rich", "rich", "as_name", "i", "text", "at", F.transform(pairs, lambda p: F.struct(p["marks"].alias("kind"), p["values"].alias("value"), p["own_values"].alias("own"))).alias("pairs"))
    # rows that repeat a text add nothing
    matched = matched.distinct()
    in_order = Window.partitionBy("doc_id", "item", "text").orderBy("at", "i")
    runs = matched.withColumn("fresh", F.coalesce((F.col("i") <= F.lag("i").over(in_order)).cast("int"), F.lit(0))).withColumn("run", F.sum("fresh").over(in_order))
    # names at the beginning of sentences are left out once: they may be none, and then they need not agree
    part = lambda kind, text, at: F.struct(F.lit(kind).alias("kind"), text.cast("long").alias("text"), at.cast("long").alias("at"))
    parts = F.array(part("whole", F.lit(None), F.lit(None)), part("shift", F.col("text"), F.col("at") - F.col("i")), part("run", F.col("text"), F.col("run")))
    parts = F.concat(F.transform(parts, lambda p: F.struct(p.alias("p"), F.lit(True).alias("all"))), F.transform(F.filter(parts, lambda p: ~F.col("as_name")), lambda p: F.struct(p.alias("p"), F.lit(False).alias("all"))))
    same = F.forall("pairs", lambda p: p["value"] == p["own"])
    count = lambda when, name: F.size(F.collect_set(F.when(when, F.col("i")))).cast("long").alias(name)
    by_part = runs.withColumn("part", F.explode(parts)).groupBy("doc_id", "item", "item_id", "n", "n_rich", "part").agg(count(F.lit(True), "n_matched"), count(F.col("rich"), "rich_matched"), count(same, "n_verbatim"), count(same & F.col("rich"), "rich_verbatim"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("slots"))
    values = F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["value"])))
    by_part = by_part.withColumn("n_slots", F.size(values).cast("long"))
    # either of all windows, or of those that have literals enough to be known by their template
    enough = lambda every, rich: (F.col(every) >= F.lit(share) * F.col("n")) | (F.col("n_rich") > 0) & (F.col(rich) >= F.lit(share) * F.col("n_rich"))
    held = enough("n_matched", "rich_matched") & (F.size("slots") == F.col("n_slots"))
    whole = lambda name: F.max(F.when((F.col("part.p.kind") == "whole") & F.col("part.all"), F.col(name))).alias(name)
    judged = by_part.groupBy("doc_id", "item", "item_id", "n", "n_rich").agg(whole("n_matched"), whole("n_slots"), whole("n_verbatim"), whole("rich_verbatim"), F.max(held).alias("held"))
    judged = judged.withColumn("verbatim", enough("n_verbatim", "rich_verbatim")).where("verbatim or held")
    return judged.select("doc_id", "item_id", "n_matched", F.col("n").alias("n_windows"), "n_slots", "verbatim")


def without_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns as they were; rows without a doc_id stay."""
    bad = leaks(docs, benchmark, width, share).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it holds; nulls, repeats and empty tables as in leaks()."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))

"""op4: personal data by bootstrapped contextual extraction, in native DataFrame operations only.

1. Seeds: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers found by patterns. Spans are places in code points. A
   text is split by a pattern once and its matches are read off once; places follow from the lengths.
2. Candidates: other words that look like identifiers (at least ``MIN_DIGITS`` digits); after a trusted pattern any token (``TOKEN``).
3. Patterns: the one and the two words before an entity, read whole; inside a word ('tel:0800-12345') its part before the entity is the
   last of them. They are told apart by 64-bit hashes. A pattern-instance graph (weighted by distinct instances) is scored in rounds:
   a pattern's score is the mean score of its instances (smoothed), an instance that is no seed gets the
   chance that not all of its patterns are wrong. Seeds keep the score 1.
4. Patterns are trusted with ``MIN_SEEDS`` distinct entities, a score of ``TRUST``, and if at least ``PRECISE`` of all places that
   their words stand before in the corpus, after a word or inside one (``PLACE``), are followed by an entity: a seed, or an instance
   of score ``TRUST``. Patterns of fewer identifier-shaped places pass on no score, so ordinary words never become patterns.
   Candidates after a trusted pattern with an instance score of ``TRUST`` are added, as the kind most of its entities have. Other
   tokens there are added if the shares of their trusted patterns give a chance of ``TRUST`` that not all are wrong, and at least
   ``PRECISE`` of the token's own places follow trusted patterns. What is added counts as an entity, wherever it stands, in the next of
   ``ROUNDS`` rounds; rounds end when nothing is added.

Every step is a projection, a partial aggregate or a join on a pattern, an instance or a document, so common words and entities are
combined before they are moved.

Defined results: a null or empty text has no spans; overlapping spans of different kinds are all listed; rows equal in id and text share
their added spans; null ids are joined null-safe; an empty table gives an empty result. ``redact`` replaces spans, longest first of
those that overlap, by their kind in square brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import WORD, few, let, scratch, stored

KINDS = ["email", "ip", "card", "phone"]
# The patterns of the seeds, written so that a failing start is not tried again inside the same run of characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![A-Za-z0-9_+#.@/-])[A-Za-z_+#-]*+[0-9][A-Za-z0-9_+#.@/-]*(?<=[A-Za-z0-9])"
MIN_DIGITS = 4
ROUNDS = 3
MIN_SEEDS = 5
TRUST = 0.8
PRECISE = 0.5
CONTEXT = 80            # characters before an entity that are read first; if its two words are longer, all are read
# Places inside a word: before a digit, a letter after no letter or digit, a plus sign with a digit, and signs that begin an identifier.
PLACE = (r"(?<![0-9 \t-\r])(?=[0-9])|(?<![\p{L}\p{M}0-9 \t-\r])(?=\p{L})|(?=\+[0-9])|"
         r"(?<![\p{L}\p{M}0-9._%+#@/ \t-\r-])(?=[._%+#-]+[A-Za-z0-9])")
MAY_HOLD = r"[^\p{L}\p{M}][^ \t-\r]|.[0-9]"         # words without this have no place inside
# What may be an identifier after a trusted pattern, whatever its characters: to a bracket, quote or separator, and to a last letter or digit.
TOKEN = r"""^[\p{L}0-9_+#.@-][^ \t-\r"'<>\[\]{},;|=&]*(?<=[\p{L}\p{N}_])"""

FOUND = "array<struct<s:int,e:int,t:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches, in code points."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(FOUND).alias("out"))

    def walk(v: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            s = acc["pos"] + F.length(F.get(v["p"], x["i"]))
            e = s + F.length(x["m"])
            return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(F.struct(
                s.alias("s"), e.alias("e"), x["m"].alias("t")))).cast(FOUND).alias("out"))
        return F.aggregate(F.transform(v["m"], lambda m, i: F.struct(m.alias("m"), i.alias("i"))), start, step)["out"]

    return let(both, walk)


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _valid(kind: str, t: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return let(digits(t), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(digits(t)).between(9, 15)
    return F.lit(True)


def seeds(text: Column) -> Column:
    """Sorted array of (s, k, e, kind, t) of the four kinds."""
    text = F.coalesce(text, F.lit(""))
    has = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}

    def of_kind(k: int, kind: str) -> Column:
        found = F.when(has.get(kind, text.rlike("[0-9]")), matches(text, PATTERNS[kind])).otherwise(F.array().cast(FOUND))
        return F.transform(F.filter(found, lambda x: _valid(kind, x["t"])), lambda x: F.struct(
            x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["t"].alias("t")))

    parts = [of_kind(k, kind) for k, kind in enumerate(KINDS)]
    return F.sort_array(F.concat(*parts))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def contexts(text: Column, at: Column) -> Column:
    """The patterns of a place, as (hash, length of the last word): the word before it (the part of its own word before it, if there is
    one), and the two words before it, in lower case."""
    gap, word = "[ \\t-\\r]", "[^ \\t-\\r]"

    def read(back: Column) -> Column:
        one, two = (F.reverse(F.regexp_extract(back, f"^{gap}*+({word}++)(?:{gap}++({word}++))?", k)) for k in (1, 2))
        return F.struct(one.alias("one"), two.alias("two"))

    def patterns(w: Column) -> Column:
        made = F.array(F.when(w["one"] != "", pattern(w["one"])), F.when(w["two"] != "", pattern(w["one"], w["two"])))
        return F.transform(F.filter(made, lambda p: p.isNotNull()), lambda p: F.struct(
            p.alias("p"), F.length(w["one"]).alias("size")))

    near = F.reverse(F.substring(text, F.greatest(at - CONTEXT, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT))))
    whole = near.rlike(f"^{gap}*+{word}++{gap}++{word}++{gap}") | (at <= CONTEXT)
    return let(F.when(whole, near).otherwise(F.reverse(F.substring(text, F.lit(1), at))), lambda back: let(read(back), patterns))


def pattern(one: Column, two: Column | None = None) -> Column:
    """Hash of the last word, or of the last two."""
    return F.xxhash64(F.lower(one) if two is None else F.concat(F.lower(two), F.lit(" "), F.lower(one)))


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, th, s, e, t, kind, pattern``: seeds, and candidates (kind null) that overlap no seed, once per pattern."""
    text = F.col("text")
    found = docs.where(text.rlike("[0-9@]")).select("doc_id", F.xxhash64("text").alias("th"), "text",
                                                    seeds(text).alias("own"), matches(text, CANDIDATE).alias("other"))
    free = F.filter("other", lambda c: (F.length(digits(c["t"])) >= MIN_DIGITS)
                    & ~F.exists("own", lambda x: (x["s"] < c["e"]) & (c["s"] < x["e"])))
    every = F.concat(F.transform("own", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"),
                                                           x["kind"].alias("kind"))),
                     F.transform(free, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["t"].alias("t"),
                                                          F.lit(None).cast("string").alias("kind"))))
    return (found.select("doc_id", "th", "text", F.explode(every).alias("o"))
            .select("doc_id", "th", "o.*", inside(text, F.col("o.s")).alias("inside"),
                    F.explode(contexts(text, F.col("o.s"))).alias("c"))
            .select("doc_id", "th", "s", "e", "t", "kind", "inside", F.col("c.p").alias("pattern"), F.col("c.size").alias("size")))


def inside(text: Column, at: Column) -> Column:
    """Whether a place is inside a word where ``PLACE`` has none (a seed that begins right after another, for instance)."""
    last = F.substring(text, F.greatest(at, F.lit(1)), F.lit(1))
    return (at > 0) & ~last.rlike("[ \\t-\\r]") & ~F.substring(text, at, F.lit(CONTEXT)).rlike(rf"^(?s:.)(?:{PLACE})")


def score_graph(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(``pattern, score, seeds, kind``, ``t, score``) from the distinct edges ``pattern, t, kind`` (kind null: no seed)."""
    instances = edges.groupBy("t").agg(F.max(F.col("kind").isNotNull().cast("double")).alias("score"))
    by_kind = (edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("n"))
               .groupBy("pattern").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"), F.sum("n").alias("seeds")))
    patterns = None
    for _ in range(rounds):
        scored = edges.join(instances, "t")
        patterns = stored(scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 0.5)).alias("score")), "pii_patterns")
        wrong = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))
        instances = stored(edges.join(patterns, "pattern").groupBy("t").agg(
            F.when(F.max(F.col("kind").isNotNull()), 1.0).otherwise(1 - wrong).alias("score")), "pii_instances")
    return patterns.join(by_kind, "pattern"), instances


def prefixes(word: Column, longest: int) -> Column:
    """The parts of a word before its places, up to ``longest`` characters, and the word."""
    def step(acc: Column, piece: Column) -> Column:
        end = acc["pos"] + F.length(piece)
        fits = (end <= longest) & (end < F.length(word))
        return F.struct(end.alias("pos"), F.when(fits, F.concat(acc["out"], F.array(F.substring(word, F.lit(1), end))))
                        .otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    parts = F.aggregate(F.split(word, PLACE, -1), start, step)["out"]
    return F.when(word.rlike(MAY_HOLD), F.concat(parts, F.array(word))).otherwise(F.array(word))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def word_counts(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``th, pattern, places``: how many places the patterns (with their ``size``) stand before in the texts, after a word or inside one."""
    longest = patterns.agg(F.max("size")).first()[0] or 0     # longer parts of words are no pattern of these

    def of_word(w: Column, x: Column, i: Column) -> Column:
        ends = prefixes(x, longest)
        return F.when(i == 0, F.transform(ends, lambda z: pattern(z))).otherwise(let(F.get(w, i - 1), lambda y: F.flatten(
            F.transform(ends, lambda z: F.array(pattern(z), pattern(z, y))))))

    places = let(words_of(F.col("text")), lambda w: F.flatten(F.transform(w, lambda x, i: of_word(w, x, i))))
    return (docs.select(F.xxhash64("text").alias("th"), F.explode(places).alias("pattern"))
            .join(few(patterns.select("pattern")), "pattern", "left_semi")
            .groupBy("th", "pattern").agg(F.count("*").alias("places")))


def offsets(word: Column) -> Column:
    """0 and the places inside a word."""
    start = F.struct(F.lit(0).alias("pos"), F.array(F.lit(0)).alias("out"))
    ends = F.aggregate(F.split(word, PLACE, -1), start, lambda acc, x: F.struct(
        (acc["pos"] + F.length(x)).alias("pos"), F.concat(acc["out"], F.array(acc["pos"] + F.length(x))).alias("out")))["out"]
    return F.when(word.rlike(MAY_HOLD), F.filter(F.array_distinct(ends), lambda k: k < F.length(word))).otherwise(F.array(F.lit(0)))


def token(word: Column, at: Column) -> Column:
    return F.regexp_extract(F.substring(word, at + 1, F.length(word)), TOKEN, 0)


def token_counts(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """``th, key, n``: how often the tokens (``key``: hash) stand at a place of the texts."""
    keys = F.flatten(F.transform(words_of(F.col("text")), lambda w: F.transform(offsets(w), lambda k: F.xxhash64(token(w, k)))))
    return (docs.select(F.xxhash64("text").alias("th"), F.explode(keys).alias("key")).join(few(tokens.select("key")), "key", "left_semi")
            .groupBy("th", "key").agg(F.count("*").alias("n")))


def token_places(docs: DataFrame, texts: DataFrame, only: DataFrame, by: str) -> DataFrame:
    """``doc_id, th, s, e, t, pattern, size, inside`` of the tokens that overlap no seed in the ``texts``, where column ``by`` is in ``only``."""
    text = F.col("text")
    at = F.flatten(F.transform(matches(text, WORD), lambda m: F.transform(offsets(m["t"]), lambda k: F.struct(
        (m["s"] + k).alias("s"), token(m["t"], k).alias("t")))))
    here = docs.withColumn("th", F.xxhash64("text")).join(few(texts), "th", "left_semi")
    free = F.filter("at", lambda c: (c["t"] != "") & ~F.exists(
        "own", lambda x: (x["s"] < c["s"] + F.length(c["t"])) & (c["s"] < x["e"])))
    rows = (here.select("doc_id", "th", "text", seeds(text).alias("own"), at.alias("at"))
            .select("doc_id", "th", "text", F.explode(free).alias("o")).withColumn("key", F.xxhash64("o.t")))
    if by == "key":
        rows = rows.join(few(only), "key", "left_semi")
    rows = (rows.select("doc_id", "th", "o.s", (F.col("o.s") + F.length("o.t")).alias("e"), "o.t", F.explode(
        contexts(text, F.col("o.s"))).alias("c")).select("doc_id", "th", "s", "e", "t", F.lit(0).cast("long").alias("inside"),
                                                         F.col("c.p").alias("pattern"), F.col("c.size").alias("size")))
    return rows if by == "key" else rows.join(few(only), "pattern", "left_semi")


def added_spans(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, th, s, e, kind`` of the identifiers that trusted patterns discover, written; what led to them is deleted."""
    with scratch() as keep:
        return keep(stored(_added_spans(docs, rounds), "pii_added"))


def _added_spans(docs: DataFrame, rounds: int) -> DataFrame:
    occ = stored(occurrences(docs), "pii_occurrences")
    # Places per text of the patterns counted so far, identifiers accepted so far (with a kind), and where the accepted tokens stand.
    counted = known = tokens = spans = seen = None
    for _ in range(rounds):
        every = occ.select("pattern", "t", "kind", "size", F.col("inside").cast("long").alias("inside"))
        if tokens is not None:
            every = every.unionByName(tokens.select("pattern", "t", F.lit(None).cast("string").alias("kind"), "size", "inside"))
        edges = every.groupBy("pattern", "t").agg(F.max("kind").alias("kind"), F.count("*").alias("n"),
                                                  F.sum("inside").alias("inside"), F.max("size").alias("size"))
        if known is not None:
            edges = (edges.join(known.select("t", F.col("kind").alias("known")), "t", "left")
                     .withColumn("kind", F.coalesce("kind", "known")).drop("known"))
        edges = stored(edges, "pii_edges")
        # Patterns of many identifier-shaped words are counted first: those mostly followed by others are ordinary and pass on no score.
        shaped = edges.groupBy("pattern").agg(F.count("*").alias("many"), F.sum("n").alias("shaped"), F.max("size").alias("size"),
                                              F.sum("inside").alias("inside"), F.max(F.col("kind").isNotNull()).alias("has"))
        asked = shaped.where((F.col("many") >= MIN_SEEDS) & F.col("has")).select("pattern", "size")
        if counted is not None:
            asked = asked.join(counted, "pattern", "left_anti")
        asked = stored(asked, "pii_asked")
        if asked.count():
            fresh = stored(word_counts(docs, asked), "pii_places")
            counted = fresh if counted is None else counted.unionByName(fresh)
        if counted is None:
            break
        places = counted.groupBy("pattern").agg(F.sum("places").alias("places"))
        shares = stored(shaped.join(places, "pattern", "left").withColumn(
            "places", F.coalesce("places", F.lit(0)) + F.col("inside")), "pii_shares")
        ordinary = shares.where((F.col("many") >= MIN_SEEDS) & F.col("has") & (F.col("shaped") < PRECISE * F.col("places")))
        edges = stored(edges.join(ordinary, "pattern", "left_anti"), "pii_edges")
        patterns, instances = score_graph(edges, ROUNDS)
        entities = (edges.join(instances, "t").where(F.col("kind").isNotNull() | (F.col("score") >= TRUST)).groupBy("pattern")
                    .agg(F.count("*").alias("entities"), F.sum("n").alias("followed")))
        trusted = stored(patterns.where(F.col("score") >= TRUST).join(entities, "pattern").join(shares.select("pattern", "places"), "pattern")
                         .where((F.col("entities") >= MIN_SEEDS) & (F.col("followed") >= PRECISE * F.col("places")))
                         .select("pattern", F.col("kind").alias("as_kind"),
                                 F.least(F.lit(1.0), F.col("followed") / F.greatest(F.col("places"), F.lit(1))).alias("share")), "pii_trusted")
        # Identifier-shaped words after a trusted pattern, by their score in the graph.
        shape = (occ.where("kind is null").join(trusted, "pattern").join(instances.where(F.col("score") >= TRUST).select("t"), "t")
                 .select("doc_id", "th", "s", "e", "t", "as_kind"))
        # Other tokens after one: not all of their patterns may be wrong, and at least PRECISE of their places must follow one.
        texts = counted.join(trusted, "pattern", "left_semi").select("th").distinct()
        after = stored(token_places(docs, stored(texts, "pii_texts"), trusted.select("pattern"), "pattern").join(trusted, "pattern")
                       .groupBy("doc_id", "th", "s", "e", "t").agg(
                           F.min("as_kind").alias("as_kind"), F.max("share").alias("top"),
                           (1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("share")))))).alias("share")), "pii_after")
        likely = stored(after.groupBy("t").agg(F.count("*").alias("follows"), F.max("share").alias("score"), F.min("as_kind").alias("kind"))
                        .where(F.col("score") >= TRUST).withColumn("key", F.xxhash64("t")), "pii_likely")
        new = likely if seen is None else likely.join(seen, "key", "left_anti")
        new = stored(new.select("key"), "pii_new")
        if new.count():
            fresh = stored(token_counts(docs, new), "pii_tokens")
            seen = fresh if seen is None else seen.unionByName(fresh)
        if seen is not None:
            stands = seen.groupBy("key").agg(F.sum("n").alias("stands"))
            found = stored(likely.join(stands, "key").where(F.col("follows") >= PRECISE * F.col("stands")), "pii_found")
            shape = shape.unionByName(after.join(found.select("t"), "t", "left_semi").select("doc_id", "th", "s", "e", "t", "as_kind"))
        now = stored(shape if spans is None else shape.unionByName(spans), "pii_spans")
        before = 0 if known is None else known.count()
        known = stored(now.groupBy("t").agg(F.min("as_kind").alias("kind")), "pii_known")
        spans = now.distinct()
        if known.count() == before:
            break
        if seen is not None:
            where = stored(seen.join(found, "key", "left_semi").select("th").distinct(), "pii_texts")
            more = token_places(docs, where, found.select("key"), "key")
            tokens = stored(more.join(occ.select("th", "s", "e", "t", "pattern"), ["th", "s", "e", "t", "pattern"], "left_anti"), "pii_token_places")
    if spans is None:
        return occ.where("false").select("doc_id", "th", "s", "e", "kind")
    # The longest of those that begin at one place: a shaped word may be a part of a token.
    return (spans.groupBy("doc_id", "th", "s").agg(F.max("e").alias("e"), F.min_by("as_kind", F.struct(-F.col("e"), "as_kind")).alias("kind")))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, th, own`` (seed spans) and ``added`` (discovered spans) of every row; both arrays of (s, k, e, kind, t)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    more = (added_spans(docs).groupBy("doc_id", "th").agg(F.collect_list(F.struct(
        "s", order[F.col("kind")].alias("k"), "e", "kind", F.lit("").alias("t"))).alias("added")))
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), seeds(F.col("text")).alias("own"))
    more = more.withColumnsRenamed({"doc_id": "m_id", "th": "m_th"})
    return own.join(more, own.doc_id.eqNullSafe(more.m_id) & (own.th == more.m_th), "left").drop("m_id", "m_th")


def report(docs: DataFrame) -> DataFrame:
    """op4's contract columns."""
    def count(kind: str) -> Column:
        return F.size(F.filter("own", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [count(kind) for kind in KINDS]
    every = F.sort_array(F.concat("own", F.coalesce("added", F.array().cast("array<struct<s:int,k:int,e:int,kind:string,t:string>>"))))
    return find(docs).select("doc_id", *n, F.sha2(listed(F.col("own")), 256).alias("base_sha256"), listed(every).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; other columns unchanged."""
    rows = docs.withColumn("p_th", F.xxhash64("text"))
    more = (added_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).groupBy("doc_id", "th")
            .agg(F.collect_list(F.struct("s", "e", "kind")).alias("p_added")).withColumnsRenamed({"doc_id": "p_id", "th": "p_m"}))
    rows = rows.join(more, rows.doc_id.cast("long").eqNullSafe(more.p_id) & (rows.p_th == more.p_m), "left")
    span = "array<struct<s:int,e:int,kind:string>>"
    own = F.transform(seeds(F.col("text")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    text = F.col("text")

    def cut(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
        ordered = F.array_sort(spans, lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1)
                               .when(a["e"] > b["e"], -1).when(a["e"] < b["e"], 1).otherwise(0))

        def step(acc: Column, x: Column) -> Column:
            whole = F.struct(x["e"].alias("pos"), F.concat(
                acc["out"], F.substring(text, acc["pos"] + 1, x["s"] - acc["pos"]),
                F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).alias("out"))
            rest = F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), acc["out"].alias("out"))   # hides the rest of an overlap
            return F.when(x["s"] >= acc["pos"], whole).otherwise(rest)

        return F.aggregate(ordered, start, step, lambda acc: F.concat(
            acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))

    clean = let(F.concat(own, F.coalesce("p_added", F.array().cast(span))), lambda s: F.when(F.size(s) == 0, text).otherwise(cut(s)))
    return rows.withColumn("p_text", F.when(text.isNotNull(), clean)).select(
        *[F.col("p_text").alias("text") if c == "text" else rows[f"`{c}`"] for c in docs.columns])

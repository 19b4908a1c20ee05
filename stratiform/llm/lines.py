"""Near-duplicate lines by a segment-partition edit join, all in DataFrame functions.

Lines within some single-character edits of each other are linked; how many is a rule
by the length of the shorter line. A line of length l is cut into edits + 1 segments; a
line with at most that many edits keeps one of them whole. Segments are indexed by
(class of lengths, segment number, hash); a line looks up only the substrings of the
multi-match-aware selection, for the class of its own length and, if they lie in another, of those down to ``edits`` less.
Letter counts, which an edit changes by two at most, drop false partners inside the
join; the rest is verified by a banded bit-parallel edit distance on the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Store, bounded, session, text_key, text_or_empty

#: Letters whose counts are compared, eight bits each. Any choice is right; frequent ones drop more.
LETTERS = "eta"
#: Pieces that a pair's shorter line is cut into before its distance is taken.
PIECES = 16
UP = 8 * len(LETTERS)  # bits of the counts; others stand above them
#: Edits by the length of the shorter line: (from so many characters on, edits), in rising order.
BY_LENGTH = ((20, 1), (64, 2), (128, 3), (256, 4))
ONE_EDIT = ((20, 1),)
LAST = 2**63 - 1  # orders rows without an id after all others
STEP = 2**31  # a place is doc_id * STEP + line_no, a whole number of up to 29 digits


def segment(size: Column, i: Column, parts: Column) -> tuple[Column, Column]:
    """(1-based start, size) of segment i of ``parts``: the last ones are longer by one."""
    base, short = F.floor(size / parts), parts - size % parts
    start = (i - 1) * base + F.greatest(F.lit(0), i - 1 - short) + 1
    return start.cast("int"), (base + F.when(i > short, 1).otherwise(0)).cast("int")


def bands(rule) -> list[tuple[int, int, int]]:
    """(least, below, edits) by the length of the shorter line."""
    return [(least, below, edits) for (least, edits), below in zip(rule, [x for x, _ in rule[1:]] + [LAST], strict=True)]


#: What stands for a band, and for a segment or a probe of it, in the literals that are exploded; columns, so that no expression is repeated.
BAND, PLACE = ("band", "e", "g", "least", "below", "j"), ("i", "shift")


def grain(edits: int) -> int:
    """Lengths from one class of partners to the next."""
    return 4 * edits if edits < 3 else 32


def by_band(band: Column, values) -> Column:
    out = F.lit(values[0])
    for i, v in enumerate(values[1:], 1):
        out = F.when(band == i, F.lit(v)).otherwise(out)
    return out


def literals(rows, names) -> Column:
    return F.array(*[F.struct(*[F.lit(x).alias(name) for x, name in zip(r, names, strict=True)]) for r in rows])


def chosen(n: Column, spans, codes, more) -> Column:
    """By length, an array of the codes of every band whose span holds it, with those of lower classes (``more``) where partners may lie there: a literal for every stretch of lengths."""
    cuts = sorted({x for span in spans for x in span[:2]})
    out = None
    for at, to in zip(cuts, cuts[1:], strict=False):
        own = [(c, m, span) for span, c, m in zip(spans, codes, more, strict=True) if span[0] <= at < span[1]]
        if own:
            few, lower = literals([c for c, _, _ in own], BAND), F.lit(False)
            for _, m, (least, _, edits) in own:
                lower = lower | ((n - least) % grain(edits) < edits) if m else lower
            some = F.when(lower, literals([x for c, m, _ in own for x in [c, *m]], BAND)).otherwise(few) if any(m for _, m, _ in own) else few
            out = F.when((n >= at) & (n < to), some) if out is None else out.when((n >= at) & (n < to), some)
    return out


def keyed(classes: DataFrame, rule, probes: bool) -> DataFrame:
    """(k, cid, x, line, n_chars, e): one row per segment of a line, or per substring that may be a partner's segment.

    Lengths are taken in classes of ``grain``, and the segments are those of a line's beginning as long as its class'
    least length: a probe meets one class, seldom two, in place of each length that a partner may have.
    For some number i from 1, exactly i - 1 of the edits lie before the shorter line's ith segment and none in it, so that its shift
    is i - 1 at the most and differs from how much shorter the line is by edits + 1 - i at the most.

    x holds the letter counts and, above them, the band, the line's length modulo 128, the segment's number and its shift.
    What is the same for all keys of a line and class is computed once, before they are exploded over small literals;
    a key is one short expression then. All of it stays in generated code. A line of one byte a character is cut as
    binary, where Spark need not count characters up to the place; the bytes that are hashed are the same either way.
    """
    of = bands(rule)
    spans, codes, more = [], [], []
    for band, (least, below, edits) in enumerate(of):
        spans.append((least, min(LAST, below + edits) if probes else below, edits))
        code = (band, edits, grain(edits), least, min(below, 2**31 - 1))
        codes.append((*code, 0))
        more.append([(*code, j) for j in range(1, -(-edits // grain(edits)) + 1)] if probes else [])
    rows = classes.select("cid", "line", "n_chars", "counts", F.inline(chosen(F.col("n_chars"), spans, codes, more)))
    n, e, g, size = F.col("n_chars"), F.col("e"), F.col("g"), F.col("size")
    once = lambda **cs: F.inline(F.array(F.struct(*[c.alias(name) for name, c in cs.items()])))  # noqa: E731  each is computed once, which keeps the generated code small
    rows = rows.select("*", once(size=n - (n - F.col("least")) % g - F.col("j") * g))
    # how much shorter a partner of this class may be
    lo, hi = F.lit(0), F.lit(0)
    if probes:
        lo = F.greatest(lo, n - (size + g - 1), n - F.col("below") + 1)
        hi = F.least(e, n - size)
        rows = rows.where((size >= F.col("least")) & (lo <= hi))
    low = F.col("counts").bitwiseOR(F.shiftleft((n % 128 * 16 + F.col("band")).cast("long"), UP))
    base, short = F.floor(size / (e + 1)).cast("int"), e + 1 - size % (e + 1)
    rows = rows.select("cid", "line", "n_chars", "e", once(low=low, size=size, base=base, short=short, bytes=F.col("line").cast("binary"), from_=lo - (e + 1), to=hi + (e + 1)))
    places = None
    for edits in sorted({e for _, _, e in of}):
        own = literals([(i, t) for i in range(1, edits + 2) for t in (range(max(1 - i, i - 1 - edits), i) if probes else (0,))], PLACE)
        places = F.when(e == edits, own) if places is None else places.when(e == edits, own)
    rows = rows.select("*", F.inline(places))
    i, shift, base, short = F.col("i"), F.col("shift"), F.col("base"), F.col("short")
    if probes:
        rows = rows.where((shift >= F.col("from_") + i) & (shift <= F.col("to") - i))
    start, size = (i - 1) * base + F.greatest(F.lit(0), i - 1 - short) + 1 + shift, base + F.when(i > short, 1).otherwise(0)
    if probes:
        rows = rows.where((start >= 1) & (start + size - 1 <= n))
    part = F.when(F.octet_length("line") == n, F.substring("bytes", start, size)).otherwise(F.substring("line", start, size).cast("binary"))
    key = F.xxhash64(F.col("size"), i, part)
    x = F.col("low").bitwiseOR(F.shiftleft(((shift + 16) * 16 + i).cast("long"), UP + 11))
    return rows.select(key.alias("k"), "cid", x.alias("x"), "line", "n_chars", "e")


def alike_ends(a: Column, b: Column, most: Column, end: bool) -> Column:
    """A length up to ``most`` of a common prefix, or suffix, found by halving steps (the longest, if shorter than 2**13)."""

    def same(at: Column, n: Column) -> Column:
        place = -(at + n) if end else at + 1
        return F.substring(a, place, n) == F.substring(b, place, n)

    return F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(13))]), F.lit(0), lambda got, n: F.when((got + n <= most) & same(got, n), got + n).otherwise(got))


def plain(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Whether every character of either text is one byte, so that both may be cut as binary, without counting up to the place."""
    return (F.octet_length(a) == na) & (F.octet_length(b) == nb)


def cut_ends(a: Column, b: Column, na: Column, nb: Column, most: Column) -> Column:
    """(p, q): lengths of a prefix and a suffix that are alike, ``most`` together."""

    def of(x: Column, y: Column) -> Column:
        both = lambda p: F.struct(p.alias("p"), alike_ends(x, y, most - p, True).alias("q"))
        return let(alike_ends(x, y, most, False), both)

    return F.when(plain(a, b, na, nb), of(a.cast("binary"), b.cast("binary"))).otherwise(of(a, b))


def between(x: Column, n: Column, cut: Column) -> Column:
    return F.substring(x, cut.p + 1, n - cut.p - cut.q)


def settled(a: Column, b: Column, na: Column, nb: Column, edits: Column, rule) -> Column:
    """Whether two texts are within ``edits``, by what lies between their common prefix and suffix."""

    def within(cut: Column) -> Column:
        out = F.lit(False)
        for e in sorted({e for _, e in rule}):
            out = F.when(edits == e, F.levenshtein(between(a, na, cut), between(b, nb, cut), e) >= 0).otherwise(out)
        return out

    return let(cut_ends(a, b, na, nb, F.least(na, nb)), within)


def letter_counts(line: str) -> Column:
    out = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        n = (F.octet_length(line) - F.octet_length(F.replace(F.col(line), F.lit(c), F.lit("")))).cast("long")
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND(255), 8 * k))
    return out


def counts_apart(a: Column, b: Column) -> Column:
    """Sum of differences of the letter counts, each taken round 256."""
    total = F.lit(0)
    for k in range(len(LETTERS)):
        d = (F.shiftright(a, 8 * k).bitwiseAND(255) - F.shiftright(b, 8 * k).bitwiseAND(255)).bitwiseAND(255)
        total = total + F.least(d, 256 - d)
    return total


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where filters move through projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def banded_distance(a: str, b: str, na: str, nb: str, edits: int) -> Column:
    """Edit distance of strings a and b with na - nb from 0 to ``edits`` (their lengths, b's above 2 * edits); above ``edits``, some larger value.

    Ends that are alike go first, so that columns are stepped through only where the texts differ; the band's width stays.
    """
    x, y, m, n = F.col(a), F.col(b), F.col(na), F.col(nb)
    pad = F.array_repeat(F.lit(""), edits)
    rest = lambda cut: let(F.concat(pad, F.split(between(x, m, cut), ""), pad), lambda u: let(F.split(between(y, n, cut), ""), lambda v: _banded(u, v, edits)))
    return let(cut_ends(x, y, m, n, n - (2 * edits + 1)), rest)


def _banded(a: Column, b: Column, edits: int) -> Column:
    """The distance of two character arrays; a has ``edits`` empty strings more at either end.

    Bit k of a word stands for row j - edits + k of column j: the band of 2 * edits + 1
    diagonals moves down one row a column. Vertical differences are kept as two words.
    """
    width = 2 * edits + 1
    full, top = (1 << width) - 1, width - 1
    m, long = F.size(a) - 2 * edits, lambda x: F.lit(x).cast("long")

    def alike(j: Column, c: Column) -> Column:
        same = long(0)
        for k in range(width):
            same = same.bitwiseOR(F.when(F.get(a, j + (k - 1)) == c, long(1 << k)).otherwise(long(0)))
        return same

    def step(acc: Column, j: Column) -> Column:
        same = let(F.get(b, j - 1), lambda c: alike(j, c))

        def with_d0(d0: Column) -> Column:
            hp = acc.vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(acc.vp)).bitwiseAND(long(full)))
            hn = d0.bitwiseAND(acc.vp)

            def with_h(h: Column) -> Column:
                down = F.shiftright(d0, 1)
                row = (m - j + edits).cast("int")  # the bit of the last row, once the band has reached it
                bit = lambda x: F.when(F.getbit(x, F.greatest(F.least(row, F.lit(top)), F.lit(0))) == 1, 1).otherwise(0)
                more = F.when(j <= m - edits, F.when(F.getbit(d0, F.lit(top)) == 1, 0).otherwise(1)).otherwise(bit(h.hp) - bit(h.hn))
                vp = h.hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(h.hp)).bitwiseAND(long(full)))
                return F.struct(vp.alias("vp"), down.bitwiseAND(h.hp).alias("vn"), (acc.d + more).alias("d"))

            return let(F.struct(hp.alias("hp"), hn.alias("hn")), with_h)

        carry = lambda x: (x.bitwiseAND(acc.vp) + acc.vp).bitwiseAND(long(full)).bitwiseXOR(acc.vp).bitwiseOR(x).bitwiseOR(acc.vn)
        return let(same, lambda x: let(carry(x), with_d0))

    first = F.struct(long(full & ~((1 << edits) - 1)).alias("vp"), long(0).alias("vn"), F.lit(edits).alias("d"))
    return F.aggregate(F.sequence(F.lit(1), F.size(b)), first, step, lambda acc: acc.d)


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per line of every text: doc_id, doc_key, line_no, line and place, a number that orders lines."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("doc_key"), F.posexplode(F.split(text_or_empty("text"), "\n")).alias("line_no", "line"))
    place = F.coalesce("doc_id", F.lit(LAST)).cast("decimal(19,0)") * F.lit(STEP).cast("decimal(10,0)") + F.col("line_no")
    return d.select("doc_id", "doc_key", "line_no", "line", place.cast("decimal(38,0)").alias("place"))


def identity(line: str) -> list[Column]:
    """128 bits that stand for a line where its text would have to be shuffled again."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def pieces_alike(a: str, b: str, na: str, nb: str, edits: int) -> Column:
    """Whether enough of a's pieces stand near their places in b, true for every pair within ``edits``; a rough look that costs little.

    An edit changes one piece at the most and moves the others by one place. Only lines of one byte a
    character are looked at, as binary; others are true.
    """
    x, y, n = F.col(a).cast("binary"), F.col(b).cast("binary"), F.col(na)

    def found(q: Column) -> Column:
        at, to = F.floor(n / PIECES * q).cast("int"), F.floor(n / PIECES * (q + 1)).cast("int")
        return F.contains(F.substring(y, F.greatest(at - edits, F.lit(0)) + 1, to - at + 2 * edits), F.substring(x, at + 1, to - at))

    same = F.aggregate(F.array(*[F.lit(q) for q in range(PIECES)]), F.lit(0), lambda got, q: got + F.when(found(q), 1).otherwise(0))
    return ~plain(F.col(a), F.col(b), n, F.col(nb)) | (same >= PIECES - edits)


def near(rule, la: str, lb: str, na: str, nb: str) -> Column:
    """Whether the longer line b is within the edits that the length of a allows.

    A look at pieces and Spark's own distance with a threshold, of what lies between ends that are alike, turn false
    partners away; the words of the bit-parallel one run in higher-order functions.
    """
    out = F.lit(False)
    for least, _, edits in bands(rule):
        maybe = (F.col(nb) - F.col(na) <= edits) & pieces_alike(la, lb, na, nb, edits) & settled(F.col(la), F.col(lb), F.col(na), F.col(nb), F.lit(edits), ((least, edits),))
        out = F.when(F.col(na) >= least, F.when(maybe, banded_distance(lb, la, nb, na, edits) <= edits).otherwise(False)).otherwise(out)
    return out


def candidates(classes: DataFrame, store: Store, rule, most: int = 16, slot: int = 4096) -> DataFrame:
    """Distinct (a, b), b the longer line or of two equally long ones the later, that share a segment and nearly all letters.

    Rows of a key that more than ``most`` lines of one length have, as templates give them, bring their
    texts, so that their pairs are settled inside the join and a group of n lines hands on
    its links, not its n * n pairs. A key of more than ``slot`` lines is dealt to several tasks.
    """
    index, probe = keyed(classes, rule, False), keyed(classes, rule, True)
    hot = index.groupBy("k", "n_chars").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    hot = store.put(hot.select(F.col("k").alias("hot"), F.col("n_chars").alias("size"), F.ceil(F.col("n") / slot).cast("int").alias("slots")), "hot-keys")
    wide = (hot.agg(F.max("slots")).first()[0] or 1) > 1
    # a probe of a hot key also meets the lines of other lengths, of which there are few
    rest = hot.select("hot", F.lit(None).cast("int").alias("size"), F.lit(1).alias("slots")).distinct()
    asked, hot = bounded(hot.unionByName(rest)), bounded(hot)

    def marked(rows: DataFrame) -> DataFrame:
        """Lines of a hot key and length have a key of their own, and their texts."""
        own = F.col("size").isNotNull()
        return rows.withColumns({"k": F.when(own, F.xxhash64("k", "size")).otherwise(F.col("k")), "line": F.when(own, F.col("line"))})

    slots = F.coalesce("slots", F.lit(1))
    i = marked(index.join(hot, (F.col("k") == F.col("hot")) & (F.col("n_chars") == F.col("size")), "left"))
    i = i.select("k", F.col("cid").alias("a"), F.col("x").alias("xa"), F.col("line").alias("la"), F.when(F.col("line").isNotNull(), F.length("line")).alias("na"), *([F.pmod(F.xxhash64("cid"), slots).cast("int").alias("s")] if wide else []))
    p = marked(probe.join(asked, F.col("k") == F.col("hot"), "left").where("size is null or size between n_chars - e and n_chars"))
    p = p.select(F.col("k").alias("k2"), F.col("cid").alias("b"), F.col("x").alias("xb"), F.col("line").alias("lb"), *([F.explode(F.sequence(F.lit(0), slots - 1)).alias("s2")] if wide else []))
    of = bands(rule)
    length = lambda x: F.shiftright(x, UP + 4).bitwiseAND(127)
    band = F.shiftright("xb", UP).bitwiseAND(15).cast("int")
    edits = by_band(band, [e for _, _, e in of])
    number, shift = F.shiftright("xb", UP + 11).bitwiseAND(15).cast("int"), (F.shiftright("xb", UP + 15).bitwiseAND(31) - 16).cast("int")
    less = ((length(F.col("xb")) - length(F.col("xa")) + 64).bitwiseAND(127) - 64).cast("int")
    once = (less <= edits) & (F.abs(less - shift) <= edits + 1 - number) & ((less > 0) | ((less == 0) & (F.col("a") < F.col("b"))))
    close = counts_apart(F.col("xa"), F.col("xb")) <= 2 * edits
    # a pair whose previous segment is alike at the same shift is met there
    long = F.col("na") - (F.col("na") - by_band(band, [x for x, _, _ in of])) % by_band(band, [grain(e) for _, _, e in of])
    at, size = segment(long, number - 1, edits + 1)
    there = (number > 1) & (shift >= F.greatest(2 - number, less - (edits + 2 - number))) & (shift <= F.least(number - 2, less + edits + 2 - number))
    before = there & (F.substring("la", at, size) == F.substring("lb", at + shift, size))
    on = (F.col("k") == F.col("k2")) & once & close & (F.col("la").isNull() | (~before & settled(F.col("la"), F.col("lb"), F.col("na"), F.col("na") + less, edits, rule)))
    # a hash join, as the index is by far the smaller side and no key of it has many rows: nothing is sorted for it
    return i.hint("shuffle_hash").join(p, on & (F.col("s") == F.col("s2")) if wide else on).select("a", "b").distinct()


def links(classes: DataFrame, store: Store, rule=BY_LENGTH) -> DataFrame:
    """Pairs (a, b) of class numbers whose texts are within the edits of ``rule``, each once."""
    pairs = store.put(candidates(classes, store, rule), "line-pairs")
    text = classes.select("cid", "line", "n_chars")
    t = pairs.join(text.select(F.col("cid").alias("a"), F.col("line").alias("la"), F.col("n_chars").alias("na")), "a").join(text.select(F.col("cid").alias("b"), F.col("line").alias("lb"), F.col("n_chars").alias("nb")), "b")
    out = store.put(t.where(near(rule, "la", "lb", "na", "nb")).select("a", "b"), "line-links")
    store.drop(pairs)
    return out


def line_classes(lines: DataFrame, store: Store, rule=BY_LENGTH) -> DataFrame:
    """One row per distinct line: h1, h2 (for its text), first (its first place), copies, n_links, linked (the first place of its links)."""
    c = lines.groupBy("line").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = store.put(c.select(F.monotonically_increasing_id().alias("cid"), *identity("line"), "first", "copies", "line", F.length("line").alias("n_chars"), F.when(F.length("line") >= rule[0][0], letter_counts("line")).alias("counts")), "line-classes")
    pairs = links(classes.where(F.col("n_chars") >= rule[0][0]), store, rule)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = classes.select(F.col("cid").alias("b"), F.col("first").alias("other"))
    linked = store.put(both.join(first, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_links"), F.min("other").alias("linked")).withColumnRenamed("a", "cid"), "line-linked")
    # lines that occur once and have no link need no row: what is known of them is in the line itself
    known = classes.select("cid", "h1", "h2", "first", "copies").join(linked, "cid", "left").where("copies > 1 or n_links is not null").drop("cid")
    out = store.put(known, "line-decisions")
    store.drop(classes, pairs, linked)
    return out


def dedup_lines(docs: DataFrame, store: Store, rule=BY_LENGTH) -> DataFrame:
    """One row per line: its class (the first place of the same line), links and whether it is kept.

    A line is dropped if the same line, or one within the edits of ``rule``, comes first: in a
    document of smaller doc_id, or earlier in its own. All is judged on the input.
    Lines of all lengths, empty ones too, have a class; lines too short for ``rule`` have
    no links; empty lines part paragraphs and are always kept. Null texts are one empty
    line; rows with a null doc_id come after all others; rows that repeat a doc_id and text
    hold the same places, so both keep or both lose a line. Very long lines are compared
    whole. An empty table gives no rows; other columns are not read.
    """
    lines = lines_of(docs)
    decided = line_classes(lines, store, rule)
    out = lines.select("doc_id", "doc_key", "line_no", *identity("line"), "place", (F.col("line") == "").alias("empty")).join(decided, ["h1", "h2"], "left")
    late = (F.coalesce("first", "place") < F.col("place")) | F.coalesce(F.col("linked") < F.col("place"), F.lit(False))
    first = F.coalesce("first", "place")
    return out.select(
        "doc_id",
        "doc_key",
        F.col("line_no").cast("long").alias("line_no"),
        F.nullif(F.expr(f"coalesce(first, place) div {STEP}"), F.lit(LAST)).alias("class_doc"),
        (first % F.lit(STEP).cast("decimal(10,0)")).cast("long").alias("class_line"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        (F.col("empty") | ~late).alias("kept"),
    )


def clean_documents(docs: DataFrame, store: Store, rule=BY_LENGTH) -> DataFrame:
    """Documents without their dropped lines, with all their columns. Documents that lose all their lines but empty ones go.

    Documents that lose no line stay as they are, null texts too. ``n_chars``, if there,
    is counted again where lines went.
    """
    lost = dedup_lines(docs, store, rule).where("not kept").groupBy("doc_id", "doc_key").agg(F.array_sort(F.collect_set("line_no")).alias("lost"))
    lost = store.put(lost, "lost-lines")
    j = docs.alias("d").join(lost.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.xxhash64(text_or_empty("d.text")) == F.col("l.doc_key")), "left")
    gone = F.col("l.lost")
    all_lines = F.split(text_or_empty("d.text"), "\n")
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(all_lines).cast("long") - 1), gone)
    rest = let(all_lines, lambda ls: F.array_join(F.transform(left, lambda i: F.get(ls, i.cast("int"))), "\n"))
    text = F.when(gone.isNull(), F.col("d.text")).otherwise(rest)
    own = {"text": text}
    j = j.where(gone.isNull() | (F.length(F.replace(text, F.lit("\n"))) > 0))
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(gone.isNull(), F.col("d.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return j.select(*[own[c].alias(c) if c in own else F.col("d." + "`" + c.replace("`", "``") + "`") for c in docs.columns])


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, links and the keep decision of every line of ``documents``; see ``dedup_lines``."""
    return dedup_lines(session(spark).read.parquet(f"{sf_dir}/documents.parquet"), Store(spark)).drop("doc_key")


ONE_BYTE = "".join(map(chr, (*range(1, 9), 11, 12, *range(14, 32))))


def _pairs_sql(least: int, below: int, edits: int) -> str:
    """Pairs of a band: of the shorter line's segments, one more than edits, the longer line holds one."""
    cut = lambda i: f"substr(a.line, a.n * {i} // {edits + 1} + 1, a.n * {i + 1} // {edits + 1} - a.n * {i} // {edits + 1})"
    held = " OR ".join(f"contains(b.line, {cut(i)})" for i in range(edits + 1))
    # DuckDB counts edits in bytes: a pair's characters beyond ASCII become control characters of one byte first
    odd = "list_sort(list_distinct(regexp_extract_all(a.line || b.line, '[^\\x00-\\x7F]')))"
    bytes_ = lambda x: f"translate({x}, array_to_string({odd}, ''), '{ONE_BYTE}'[1:len({odd})])"
    # equal joins on each length that the longer line may have
    parts = [f"SELECT a.line AS x, b.line AS y, a.first AS fx, b.first AS fy FROM c a JOIN c b ON b.n = a.n + {d} WHERE a.n >= {least} AND a.n < {below} AND ({held})" + (" AND a.line < b.line" if not d else "") + f" AND levenshtein(a.line, b.line) <= {4 * edits} AND levenshtein({bytes_('a.line')}, {bytes_('b.line')}) <= {edits}" for d in range(edits + 1)]
    return " UNION ALL ".join(parts)


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM d),
c AS (SELECT line, length(line) AS n, count(*) AS copies, min({{'doc': doc_id, 'line': line_no}}) AS first FROM l GROUP BY line),
p AS MATERIALIZED ({" UNION ALL ".join(_pairs_sql(*b) for b in bands(BY_LENGTH))}),
e AS (SELECT x AS line, fy AS other FROM p UNION ALL SELECT y, fx FROM p),
k AS (SELECT line, count(*) AS n_links, min(other) AS linked FROM e GROUP BY line)
SELECT doc_id, line_no, c.first.doc AS class_doc, c.first.line AS class_line, copies, coalesce(n_links, 0) AS n_links,
  l.line = '' OR NOT (c.first < {{'doc': doc_id, 'line': line_no}} OR coalesce(k.linked < {{'doc': doc_id, 'line': line_no}}, false)) AS kept
FROM l JOIN c ON l.line = c.line LEFT JOIN k ON l.line = k.line
"""

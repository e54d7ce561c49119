"""Line deduplication by segment-partition edit joins, in DataFrame functions only.

Two lines within k edits share one of k + 1 segments of the shorter one, at
about the same place. So each distinct line is cut into k + 1 segments, under
keys of (length or class of lengths, segment number, segment), and looked up
with those of its substrings that can be such a segment of a line of its length
or shorter. What shares a key is verified with a banded bit-parallel edit
distance: one word holds the vertical differences of a column of the band.

A line goes if a line that is equal or within k edits stands earlier. Equal
lines are brought together first, so that near lines are sought among distinct
lines only. Keys are shuffled as hashes of KEY_BITS bits, without the line they
are of, and counted; those of several lines, one of which holds the key as its
segment, are then looked up in the lines. A key is never expanded into all
pairs of its lines: keys of many lines are narrowed (see narrowed() and
by_length()), and in each round some of a key's earliest lines (eight times as
many each round) are compared with later ones not yet decided.

How many edits count as near grows with the shorter line, see allowed(). From
two edits on, lines fall into classes by length and the k + 1 segments have one
size in a class, so that their keys need no exact length: see wide_keys().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sizes import broadcast_if_small
from .common import carried, documents, id_text, salted_left_join, staged

#: Characters of the shorter line for each edit that counts as near, and edits (the length of a word) at which that ends.
CHARS_PER_EDIT, MOST_EDITS = 16, 8
#: Shorter lines (in code points) are left as they are. Lines of less than CHARS_PER_EDIT are near none, so only their copies go.
MIN_CHARS = 1
#: Bits of a key; keys that are equal by chance cost a comparison, as lines decide.
KEY_BITS = 48
#: Keys of more lines are cut further; windows that keys are cut into, at first and then.
SMALL, FEW, MANY = 8, 4, 16
#: Up to so many keys, and numbers of removed lines, are broadcast (16 bytes each at most); more are joined by a shuffle.
WANTED_ROWS = 500_000
#: Classes of the lines of MOST_EDITS that one doubling of the length is cut into.
STEPS_A_DOUBLING = 3
#: From so many characters of a segment on, of how many grams of it one is the key; a segment of g characters has w grams of g - w + 1 (16 numbers are kept for them).
GRAMS = [(13, 2), (15, 4), (22, 8)]
#: Letters that are counted in a text, six in a number, the last with all other characters; an edit changes two of the counts by one at most. The highest bit of each is free for comparisons.
LETTERS, BITS_A_LETTER = ["etaoin", "shrdlu", "cmwfgp", "ybvkx"], 10
#: Characters of the pieces of a line that are sought in the other line before it is compared.
PIECE = 3
#: Pieces that are sought at first, and characters up to which all of them are.
SOUGHT, SHORT = 48, 600
#: Keys of many lines are cut by length where that parts lines of so many characters' difference.
SPREAD = 96
#: Characters after each of which a comparison ends if no value of the band's column is small enough.
LOOKS = [24, 72, 216]
#: Steps in which the common ends of two lines are found; what is common beyond their sum is compared like the rest.
STEPS = [1 << i for i in range(15, -1, -1)]
#: The free bits of a number of counts.
FREE = sum(1 << BITS_A_LETTER * (i + 1) - 1 for i in range(len(LETTERS[0])))
ID = ["k1", "k2"]
#: What a member of a key carries, and what is known of the line on both sides of the key's characters.
CARRY = ["id", "own", "at", "size"]
SIDES = ["i", *(f"{side}_{x}" for side in ("before", "behind") for x in ("n", *range(len(LETTERS))))]
#: Order of lines: a null doc_id stands behind all others.
AT = ["unknown", "first", "pos", "k1", "k2"]


def line_id(line: Column) -> list[Column]:
    """128 bits that stand for the line."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(7), line).alias("k2")]


def has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\n\x0b\f\r")) != ""


def occurrences(docs: DataFrame, min_chars: int, *more: Column) -> DataFrame:
    """(doc_id, .., pos, line): all lines that are long enough and have a word."""
    found = docs.select("doc_id", *more, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return found.filter((F.length("line") >= min_chars) & has_word(F.col("line")))


def distinct_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, k1, k2, unknown, first, pos, line, size, n): each distinct line, where it stands first, its length and how often it stands."""
    found = occurrences(docs, min_chars).select(*line_id(F.col("line")), F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("first"), "pos", "line").alias("m"))
    found = found.groupBy(*ID).agg(F.min("m").alias("m"), F.count("*").alias("n"))
    return found.select(F.monotonically_increasing_id().alias("id"), *ID, "m.*", F.length("m.line").alias("size"), "n")


def segment(length: Column, i: Column, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of the i-th (from 0) of edits + 1 even segments; the last ones are longer by one."""
    parts = edits + 1
    short = F.floor(length / parts).cast("int")
    even = F.lit(parts) - F.pmod(length, F.lit(parts)).cast("int")
    own = short + F.when(i >= even, 1).otherwise(0)
    return (short * i + F.greatest(F.lit(0), i - even) + 1).cast("int"), own.cast("int")


def hashed(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def even_bytes() -> Column:
    """The line with four bytes for each character, so that cut() need not count characters from its start."""
    return F.encode("line", "UTF-32").alias("line")


def cut(start: Column, size: Column) -> Column:
    """Characters of an even_bytes() line, from `start` (from 1)."""
    return F.substring(F.col("line"), start * 4 - 3, size * 4)


def placed(lines: DataFrame, codes: Column) -> DataFrame:
    """lines with a row for each code, and its three numbers a, i and shift; constant lists, so that keys are made in generated code."""
    rows = lines.select("id", even_bytes(), F.col("size").alias("n"))
    rows = rows.select("id", "line", "n", F.explode(codes).alias("c"))
    return rows.select("id", "line", "n", F.shiftright("c", 16).alias("a"), F.shiftright("c", 8).bitwiseAND(F.lit(255)).alias("i"), (F.col("c").bitwiseAND(F.lit(255)) - 64).alias("shift"))


def coded(places: list[tuple[int, int, int]]) -> Column:
    return F.array(*(F.lit(a << 16 | i << 8 | shift + 64) for a, i, shift in places))


def even_keys(lines: DataFrame, edits: int, holds: Column) -> DataFrame:
    """(id, key, own, i, shorter, start, width) for lines within a fixed number of edits.

    own: the line itself holds the key as a segment (and `holds` is true);
    i: number of the segment; shorter: how much shorter the other line is;
    start, width: where the key's characters stand in the line, from 1.
    """
    places = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            # what lies to the left may hold up to i edits, what lies to the right edits - i
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            places += [(shorter, i, shift) for shift in range(low, high + 1)]
    start, size = segment(F.col("n") - F.col("a"), F.col("i"), edits)
    at = placed(lines, coded(places)).withColumns({"start": start + F.col("shift"), "width": size})
    at = at.filter("start >= 1 and start + width - 1 <= n and width >= 1")
    key = hashed(F.col("n") - F.col("a"), F.col("i"), cut(F.col("start"), F.col("width")))
    return at.select("id", key.alias("key"), ((F.col("a") == 0) & (F.col("shift") == 0) & holds).alias("own"), "i", F.col("a").alias("shorter"), "start", "width")


def allowed(n: Column) -> Column:
    """Edits up to which a line is near one of n characters, if no other line is shorter."""
    return F.least(F.lit(MOST_EDITS), F.floor(n / CHARS_PER_EDIT)).cast("int")


def classed(lines: DataFrame, *more: str) -> DataFrame:
    """lines of two edits or more with their class, k edits and least length m, and with the class below, kb and mb, in which they are looked up if `under`."""
    top = CHARS_PER_EDIT * MOST_EDITS
    n = F.col("size")
    bound = lambda step: F.floor(F.pow(F.lit(2.0), step / STEPS_A_DOUBLING) * top).cast("int")
    # the floor of a logarithm may be one off, so the bounds decide
    guess = F.floor(F.log2(n / F.lit(float(top))) * STEPS_A_DOUBLING)
    lines = lines.select("id", "size", *more, guess.alias("_g"))
    step = F.when(n >= bound(F.col("_g") + 1), F.col("_g") + 1).when(n < bound(F.col("_g")), F.col("_g") - 1).otherwise(F.col("_g"))
    lines = lines.select("id", "size", *more, step.alias("_g"))
    least = F.when(n >= top, bound(F.col("_g"))).otherwise(allowed(n) * CHARS_PER_EDIT)
    below = F.when((n >= top) & (F.col("_g") > 0), bound(F.col("_g") - 1)).otherwise(least - CHARS_PER_EDIT)
    found = lines.select("id", "size", *more, allowed(n).alias("k"), least.cast("int").alias("m"), below.cast("int").alias("mb"))
    found = found.withColumn("kb", allowed(F.col("mb")))
    return found.withColumn("under", (F.col("kb") >= 2) & (n - F.col("kb") < F.col("m")))


def spots(rows: DataFrame, *more: str) -> DataFrame:
    """Of rows with a class and `which`, 1 for the class below, and i: the class, and where the i-th segment's grams stand.

    first: of the first gram of the first place that the segment can be shifted
    to; far: the most that it can be shifted; grams, gram: how many grams a
    segment has, and their characters; width: the segment's.
    """
    own = F.col("which") == 0
    rows = rows.select(*more, "size", "which", "i", F.when(own, F.col("k")).otherwise(F.col("kb")).alias("k"), F.when(own, F.col("m")).otherwise(F.col("mb")).alias("m"))
    rows = rows.withColumn("width", F.floor(F.col("m") / (F.col("k") + 1)).cast("int"))
    grams = F.lit(1)
    for least, count in GRAMS:
        grams = F.when(F.col("width") >= least, count).otherwise(grams)
    far = F.least(F.col("i"), F.col("k") - F.col("i"))
    start = F.when(F.col("i") * 2 <= F.col("k"), F.col("i") * F.col("width")).otherwise(F.col("size") - (F.col("k") + 1 - F.col("i")) * F.col("width"))
    rows = rows.withColumns({"grams": grams, "far": far.cast("int"), "first": (start + 1 - far).cast("int")})
    parts = F.struct("grams", "far", "first", "width", (F.col("width") - F.col("grams") + 1).alias("gram"))
    return rows.select(*more, "size", "i", "which", "m", once(parts).alias("_s")).select(*more, "size", "i", "which", "m", "_s.*")


def wide_keys(lines: DataFrame) -> DataFrame:
    """(key, place) for all lines of two edits or more at once; place tells the line and where the key is in it, see unpacked().

    A class is of one number k of edits and the least length m of its lines;
    those of MOST_EDITS have STEPS_A_DOUBLING values of m for each doubling. The k + 1 segments of a class have equal
    sizes: the first half is counted from the line's start, the others from its
    end. Of the segments of the shorter line there is one, the i-th, that is
    intact with i edits at most before it and k - i behind it, so its place in
    the other line is off by no more than that from the nearer end. The longer
    line may be of the next class, so a line near the lower end of its class is
    looked up in the class below too.

    A segment's key is not the segment but one of its grams (see GRAMS), that
    with the largest hash, the last of equal ones. What is equal as a segment
    has the same gram at the same place; and a segment that is shifted by a
    character mostly has the same one too, so that most shifts need no key.
    """
    codes = lambda which, k: [which << 4 | i for i in range(k + 1)]
    rows, chosen = classed(lines.select("id", "size", even_bytes()), "line"), None
    for k in range(2, MOST_EDITS + 1):
        for kb in {k - 1, k if k == MOST_EDITS else k - 1}:
            if kb >= 2:
                case, both = (F.col("k") == k) & F.col("under") & (F.col("kb") == kb), F.array(*map(F.lit, codes(0, k) + codes(1, kb)))
                chosen = F.when(case, both) if chosen is None else chosen.when(case, both)
    for k in range(2, MOST_EDITS + 1):
        chosen = chosen.when(F.col("k") == k, F.array(*map(F.lit, codes(0, k))))
    rows = rows.select("*", F.explode(chosen).alias("_c"))
    rows = rows.withColumns({"which": F.shiftright("_c", 4), "i": F.col("_c").bitwiseAND(F.lit(15))})
    rows = spots(rows, "id", "line")

    far, most = MOST_EDITS // 2, max(count for _, count in GRAMS)
    # a gram's hash, with its number in the four bits below
    one = lambda j: F.xxhash64(cut(F.col("first") + j, F.col("gram"))).bitwiseAND(F.lit(-16)).bitwiseOR(F.lit(j).cast("long"))
    rows = rows.select("*", once(F.array(*(F.when(F.lit(j) < F.col("far") * 2 + F.col("grams"), one(j)) for j in range(2 * far + most)))).alias("_1"))
    for n in (2, 4, 8):
        # largest of n grams in a row, where there are so many
        last, length = F.col(f"_{n // 2}"), 2 * far + most - n + 1
        wider = F.array(*(F.greatest(F.get(last, F.lit(j)), F.get(last, F.lit(j + n // 2))) for j in range(length)))
        rows = rows.select("*", once(F.when(F.col("grams") >= n, wider).otherwise(last)).alias(f"_{n}"))
    fits = lambda t: (F.lit(t) <= F.col("far") * 2) & (F.col("first") + t >= 1) & (F.col("first") + t + F.col("width") - 1 <= F.col("size"))
    rows = rows.select("*", once(F.array(*(F.when(fits(t), F.get("_8", F.lit(t))) for t in range(2 * far + 1)))).alias("_k"))
    held = F.get("_k", F.col("far"))
    rows = rows.select("id", "which", "i", "m", held.alias("_held"), F.explode(F.array_distinct("_k")).alias("_g")).filter("_g is not null")
    key = hashed(F.lit(-1), F.col("m"), F.col("i"), F.shiftright("_g", 4))
    own = ((F.col("which") == 0) & (F.col("_g") == F.coalesce("_held", F.lit(0)))).cast("long")
    place = F.shiftleft("id", 10).bitwiseOR(F.col("_g").bitwiseAND(F.lit(15)) * 32 + F.col("i") * 2 + F.col("which") * 512 + own)
    return rows.select(key.alias("key"), place.alias("place"))


def unpacked(members: DataFrame, known: DataFrame) -> DataFrame:
    """(key, id, own, i, shorter, start, width) of members (key, place) of wide_keys(); start, width: where the gram stands in the line, from 1."""
    bits = lambda shift, mask: F.shiftright("place", shift).bitwiseAND(F.lit(mask)).cast("int")
    found = members.select("key", F.shiftright("place", 10).alias("id"), (bits(0, 1) == 1).alias("own"), bits(1, 15).alias("i"), bits(5, 15).alias("_j"), bits(9, 1).alias("which"))
    found = spots(found.join(classed(known), "id"), "key", "id", "own", "_j")
    return found.select("key", "id", "own", "i", F.lit(-1).alias("shorter"), (F.col("first") + F.col("_j")).alias("start"), F.col("gram").alias("width"))


def wide_members(lines: DataFrame) -> DataFrame:
    """(key, place) of the keys of several lines, one of which holds the key in a segment of its own.

    Keys are made and dealt out once; what is shared is found where they lie.
    """
    # the filter keeps all rows; without it Spark plans the join's shuffle as one of another kind, and deals the keys out twice
    dealt = wide_keys(lines).repartition("key")
    of = F.shiftright("place", 10)
    shared = dealt.groupBy("key").agg(F.min(of).alias("a"), F.max(of).alias("b"), F.max(F.col("place").bitwiseAND(F.lit(1))).alias("held"))
    shared = shared.filter("a <> b and held = 1").select("key")
    return dealt.filter(F.monotonically_increasing_id() >= 0).join(shared.hint("shuffle_hash"), "key", "left_semi")


def one_edit_keys(lines: DataFrame) -> DataFrame:
    """even_keys() of the lines that may be near others within one edit."""
    two = 2 * CHARS_PER_EDIT
    # the longer line of a pair with one edit may be of the next class; what it holds itself is then found in that
    return even_keys(lines.filter(F.col("size").between(CHARS_PER_EDIT, two)), 1, F.col("n") < two)


def even_members(keyed: DataFrame) -> DataFrame:
    """even_keys() of several lines, one of which holds the key as a segment."""
    shared = staged(shared_keys(keyed), "shared")
    return staged(keyed.join(broadcast_if_small(shared, WANTED_ROWS), "key", "left_semi"), "members")


def shared_keys(keyed: DataFrame) -> DataFrame:
    """(key) of the keys that stand twice at least, once as a segment; counted before the shuffle and in one number."""
    own = 1 << 32
    found = keyed.groupBy("key").agg(F.sum(F.when(F.col("own"), F.lit(own + 1)).otherwise(F.lit(1))).alias("s"))
    return found.filter((F.col("s") >= own) & (F.col("s") % own >= 2)).select("key")


def worth_a_look(members: DataFrame) -> DataFrame:
    """(key) of the keys of several lines, one of which holds it as a segment."""
    found = members.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max("own").alias("held"))
    return found.filter("a <> b and held").select("key")


def letters(text: Column) -> Column:
    """How often each of LETTERS is in a text, and its length, as an array."""
    each = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(x), F.lit(""))) for group in LETTERS for x in group]
    return F.array(*each, F.length(text))


def counted(counts: str, side: str) -> list[Column]:
    """A text's length and its letters() in one number for each group of LETTERS, and any other character with the last of these."""
    most, n = (1 << BITS_A_LETTER - 1) - 1, sum(map(len, LETTERS))
    size = F.get(counts, F.lit(n))
    found, i = [size.alias(f"{side}_n")], 0
    for g, group in enumerate(LETTERS):
        each = [F.get(counts, F.lit(i + j)) for j in range(len(group))]
        i += len(group)
        if g == len(LETTERS) - 1:
            each.append(size - F.aggregate(F.slice(counts, 1, n), F.lit(0), lambda x, y: x + y))
        numbers = F.lit(0).cast("long")
        for j, x in enumerate(each):
            numbers = numbers.bitwiseOR(F.shiftleft(F.least(F.lit(most), x).cast("long"), BITS_A_LETTER * j))
        found.append(numbers.alias(f"{side}_{g}"))
    return found


def sides(members: DataFrame, lines: DataFrame) -> DataFrame:
    """CARRY and SIDES of members under keys: i, and what stands before and behind the key's characters, as lengths and counts of letters.

    Of a near pair's shared segments there is one, the i-th, with i edits at
    most before it and the other allowed ones behind it (see wide_keys()), so
    the two sides are held against each other on their own.
    """
    cut = members.join(lines.select("id", "line"), "id")
    cut = cut.select("*", once(F.struct(F.expr("substring(line, 1, start - 1)").alias("a"), F.expr("substring(line, start + width)").alias("b"))).alias("_s"))
    cut = cut.select("key", *CARRY, "i", once(F.struct(letters(F.col("_s.a")).alias("a"), letters(F.col("_s.b")).alias("b"))).alias("_n"))
    return cut.select("key", *CARRY, "i", *counted("_n.a", "before"), *counted("_n.b", "behind"))


def undivided(members: DataFrame, lines: DataFrame) -> DataFrame:
    """CARRY and SIDES of members under keys that are not told apart by their place: the whole line stands behind them."""
    whole = lines.select("id", once(letters(F.col("line"))).alias("_n")).select("id", *counted("_n", "behind"))
    nothing = [F.lit(0).alias("i"), F.lit(0).alias("before_n"), *(F.lit(0).cast("long").alias(f"before_{g}") for g in range(len(LETTERS)))]
    return members.join(whole, "id").withColumns({c: x for c, x in zip(SIDES, nothing)}).select("key", *CARRY, *SIDES)


def may_be_near(edits: int | None) -> str:
    """Condition on lengths and counts of letters that lines within `edits` edits fulfil under one of the keys they share.

    An edit gives one side a character more than the other at most. Counts are
    subtracted six at a time: a free bit set above each keeps them apart, and
    what is left of it tells which differences are not negative. Their sum is
    the remainder by 2 ** BITS_A_LETTER - 1 (less, if it is that much, which
    only lets more pairs pass).
    """
    most = str(edits) if edits is not None else f"least({MOST_EDITS}, floor(least(size, _size) / {CHARS_PER_EDIT}))"

    def more(x: str, y: str) -> str:
        """How many letters x has that y has not."""
        off = [f"({x}_{g}_f - {y}_{g})" for g in range(len(LETTERS))]
        return " + ".join(f"({o} & (({o} & {FREE}L) - shiftright({o} & {FREE}L, {BITS_A_LETTER - 1}))) % {(1 << BITS_A_LETTER) - 1}L" for o in off)

    def side(x: str, most: str) -> str:
        return f"abs({x}_n - _{x}_n) <= {most} and {more(x, f'_{x}')} <= {most} and {more(f'_{x}', x)} <= {most}"

    return f"i = _i and abs(size - _size) <= {most} and {side('behind', most + ' - i')} and {side('before', 'i')}"


def compared(members: DataFrame, prefix: str = "") -> list[Column]:
    """What may_be_near() reads, never null, so that the join's condition is short enough to be compiled."""
    known = lambda x: F.coalesce(F.col(x), F.lit(0).cast(dict(members.dtypes)[x]))
    free = [known(x).bitwiseOR(F.lit(FREE)).alias(f"{prefix}{x}_f") for x in SIDES if x[-1].isdigit()]
    return [*(known(x).alias(f"{prefix}{x}") for x in ["n", "size", *SIDES]), F.coalesce("own", F.lit(False)).alias(f"{prefix}own"), *free]


def narrowed(members: DataFrame, lines: DataFrame) -> DataFrame:
    """For one edit: keys of all but a window of a line, in place of keys of half a line.

    Lines that share a half agree in all of the rest but one place. So the rest
    is cut into windows, and a line goes on under a key for each: what lies
    before it, and what lies behind it. First all keys are cut into FEW windows
    and then, again and again, those still of more than SMALL lines into MANY,
    until their windows are single places; lines that share such a key are
    within one edit. So no key of many lines is left whose lines are to be
    compared with each other.
    """
    known = lines.select("id", "line", F.col("size").alias("n"))
    _, first = segment(F.col("n") - F.col("shorter"), F.lit(0), 1)
    _, last = segment(F.col("n") - F.col("shorter"), F.lit(1), 1)
    size = F.when(F.col("i") == 0, first).otherwise(last)
    rest = F.when(F.col("i") == 0, F.substring(F.col("line"), size + 1, F.col("n"))).otherwise(F.substring(F.col("line"), F.lit(1), F.col("n") - size))
    current = members.withColumns({"lo": F.lit(0), "hi": F.lit(-1)})
    done, large, parts = None, current, FEW
    while True:
        cut = large.join(known, "id").withColumns({"_rest": rest, "_r": F.col("n") - F.col("shorter") - size})
        cut = cut.withColumn("hi", F.when(F.col("hi") < 0, F.col("_r")).otherwise(F.col("hi")))
        width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / parts)).cast("int")
        ends = F.sequence(F.col("lo"), F.greatest(F.col("lo"), F.col("hi") - 1), width)
        cut = cut.withColumn("_w", width).withColumn("lo", F.explode(ends)).withColumn("hi", F.least(F.col("lo") + F.col("_w"), F.col("hi")))
        behind = F.col("_r") - F.col("hi")
        before = F.substring(F.col("_rest"), F.lit(1), F.col("lo"))
        after = F.substring(F.col("_rest"), F.length("_rest") - behind + 1, behind)
        cut = cut.select(F.xxhash64("key", "lo", before, F.lit(1), after).alias("key"), *CARRY, "i", "shorter", "lo", "hi")
        cut = staged(cut, "cut")
        cut = cut.join(worth_a_look(cut), "key", "left_semi").groupBy("key", "id", "at", "size", "i", "shorter", "lo", "hi").agg(F.max("own").alias("own"))
        cut = staged(cut, "cut")
        heavy = cut.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("hi") - F.col("lo")).alias("w")).filter((F.col("n") > SMALL) & (F.col("w") > 1))
        heavy = staged(heavy.select("key"), "heavy")
        small = cut.join(heavy, "key", "left_anti").select("key", *CARRY)
        done = small if done is None else done.union(small)
        if heavy.isEmpty():
            return staged(done, "narrowed")
        large, parts = cut.join(heavy, "key", "left_semi"), MANY


def by_length(members: DataFrame, lines: DataFrame) -> DataFrame:
    """For more edits: members of keys of many lines with their sides, and the keys cut by the lines' length where lengths differ much.

    Near lines' lengths differ by MOST_EDITS at most. So a line goes on under
    the key with its step of that many lengths, and under those with the steps
    before and behind, as one that only looks up the lines there. Where all
    lengths are much the same this would only repeat the lines.
    """
    heavy = members.groupBy("key").agg(F.count("*").alias("n"), (F.max("size") - F.min("size") >= SPREAD).alias("spread"))
    heavy = staged(heavy.filter(F.col("n") > SMALL).select("key", "spread"), "heavy")
    small = undivided(members.join(heavy, "key", "left_anti"), lines)
    if heavy.isEmpty():
        return small
    cut = sides(members.join(heavy.filter("spread").select("key"), "key", "left_semi"), lines).withColumn("_step", F.floor(F.col("size") / MOST_EDITS))
    cut = cut.withColumn("_by", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    cut = cut.select(F.xxhash64("key", F.col("_step") + F.col("_by")).alias("key"), "id", (F.col("own") & (F.col("_by") == 0)).alias("own"), "at", "size", *SIDES)
    cut = staged(cut, "cut")
    even = sides(members.join(heavy.filter("not spread").select("key"), "key", "left_semi"), lines)
    return small.unionByName(cut.join(worth_a_look(cut), "key", "left_semi")).unionByName(even)


def once(value: Column) -> Column:
    """The value as a column of a row of its own, so that it is computed once and not wherever it is used."""
    return F.explode(F.array(value))


def common_start(a: Column, b: Column, most: Column) -> Column:
    """Length of what both lines begin with, up to the sum of STEPS; most: the length of the shorter one. Give columns, as each step reads all three."""
    longer = lambda p, s: F.when((p + s <= most) & (F.substring(a, p + 1, s) == F.substring(b, p + 1, s)), p + s).otherwise(p)
    return F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), longer)


def missing_pieces(a: str, b: str, edits: int, sought: int | None = None) -> Column:
    """How many pieces of a (of about `sought` of them, if given) are nowhere in b within `edits` places of their own; each of them takes an edit, as they don't overlap."""
    window = f"substring({b}, greatest(1, {PIECE} * i + 1 - {edits}), {PIECE + edits} + least({edits}, {PIECE} * i))"
    step = 1 if sought is None else f"greatest(1, cast(length({a}) div {PIECE * sought} as int))"
    pieces = f"sequence(0, greatest(0, cast(length({a}) div {PIECE} as int) - 1), {step})"
    return F.expr(f"size(filter({pieces}, i -> instr({window}, substring({a}, {PIECE} * i + 1, {PIECE})) = 0))")


def distances(pairs: DataFrame, a: str, b: str, edits: int, most: Column | None = None) -> DataFrame:
    """pairs with `_distance` of the lines a and b, null where it is more than `edits` (31 at most).

    Pairs may be left out whose distance is more than `edits`, or than `most`.

    What both lines begin and end with is left out. Of the rest, a column of the
    band of 2 * edits + 1 diagonals stands for one character of b: bit d says
    whether the value goes up (vp) or down (vn) from row to row. A column
    follows from the one before in a few operations on whole words, and the
    value in the band's last row is kept up to date. Rows before a's start rise
    with the column, rows behind its end match nothing.
    """
    width = 2 * edits + 1
    long = lambda n: F.lit(n).cast("long")
    full, last = long((1 << width) - 1), 1 << width - 1

    near = pairs.filter(F.abs(F.length(a) - F.length(b)) <= edits)
    near = near.select("*", once(F.least(F.length(a), F.length(b))).alias("_n"))
    near = near.select("*", once(common_start(F.col(a), F.col(b), F.col("_n"))).alias("_p"))
    near = near.select("*", once(F.struct(*(F.expr(f"substring({x}, _p + 1)").alias(y) for x, y in ((a, "a"), (b, "b"))))).alias("_s"))
    near = near.select("*", once(F.struct(F.reverse("_s.a").alias("a"), F.reverse("_s.b").alias("b"), F.least(F.length("_s.a"), F.length("_s.b")).alias("n"))).alias("_v"))
    near = near.select("*", once(common_start(F.col("_v.a"), F.col("_v.b"), F.col("_v.n"))).alias("_q"))
    # most pairs are variants of one line that differ in several places, which pieces tell without a step for each character
    near = near.select("*", once(F.struct(*(F.expr(f"substring(_s.{y}, 1, length(_s.{y}) - _q)").alias(y) for y in ("a", "b")))).alias("_m"))
    bound = F.lit(edits) if most is None else most
    near = near.filter(missing_pieces("_m.a", "_m.b", edits, SOUGHT) <= bound)
    # a character's place is found from a text's start, so all pieces of long lines would take the square of their length
    near = near.filter((F.length("_m.a") <= PIECE * SOUGHT) | (F.length("_m.a") > SHORT) | (missing_pieces("_m.a", "_m.b", edits) <= bound))
    rest = lambda y: F.expr(f"if(_m.{y} <> '', split(_m.{y}, ''), cast(array() as array<string>))").alias(y)
    near = near.select("*", once(F.struct(rest("a"), rest("b"))).alias("_r"))

    def equal(c: Column, j: Column) -> Column:
        """The bits of the rows j - edits .. j + edits whose character of a is c; both count from 0."""
        found = None
        for d in range(width):
            bit = F.when(F.get("_r.a", j + (d - edits)) == c, long(1 << d)).otherwise(long(0))
            found = bit if found is None else found.bitwiseOR(bit)
        return found

    def matches(some: Column, done: int) -> Column:
        return F.transform(some, lambda c, j: equal(c, j + done))

    def step(state: Column, x: Column) -> Column:
        vp, vn = state["vp"], state["vn"]
        d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(full)
        # one element, so that it is computed once
        return F.get(F.transform(F.array(d0), lambda d: column(d, vp, vn, state["v"])), F.lit(0))

    def column(d0: Column, vp: Column, vn: Column, value: Column) -> Column:
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(full)
        up = F.shiftright(d0, 1)
        return F.struct(
            d0.bitwiseAND(vp).bitwiseOR(F.bitwise_not(up.bitwiseOR(hp))).bitwiseAND(full).alias("vp"),
            up.bitwiseAND(hp).alias("vn"),
            (value + F.when(d0.bitwiseAND(long(last)) == 0, long(1)).otherwise(long(0))).alias("v"),
        )

    start = F.struct(long((1 << width) - (1 << edits)).alias("vp"), long(0).alias("vn"), long(edits).alias("v"))
    # most lines that are not near differ too much after some characters, so the others alone are compared to their ends
    near, done = near.select("*", once(start).alias("_e")), 0
    for end in LOOKS:
        some = F.slice("_r.b", done + 1, end - done)
        state = F.aggregate(matches(some, done), F.col("_e"), step)
        near = near.select(*(c for c in near.columns if c != "_e"), once(F.when(F.size("_r.b") > done, state).otherwise(F.col("_e"))).alias("_e"))
        least = F.least(*(F.col("_e.v") - F.bit_count(F.col("_e.vp").bitwiseAND(long(above))) + F.bit_count(F.col("_e.vn").bitwiseAND(long(above))) for above in (last - (1 << d) for d in range(width))))
        near, done = near.filter(least <= bound), end
    tail = F.slice("_r.b", done + 1, F.greatest(F.lit(0), F.size("_r.b") - done))
    end = F.aggregate(matches(tail, done), F.col("_e"), step)
    near = near.select(*(c for c in near.columns if c != "_e"), once(end).alias("_e"))
    # from the band's last row up to a's last one
    low = F.size("_r.a") - F.size("_r.b") + edits
    mask = F.expr(f"{last - 1}L & ~(shiftleft(1L, {edits} + size(_r.a) - size(_r.b)) - 1L)")
    value = F.col("_e.v") - F.bit_count(F.col("_e.vp").bitwiseAND(mask)) + F.bit_count(F.col("_e.vn").bitwiseAND(mask))
    return near.withColumn("_distance", F.when((low >= 0) & (value <= edits), value)).drop("_n", "_p", "_s", "_v", "_q", "_m", "_r", "_e")


def bit_parallel(pairs: DataFrame, a: str, b: str, edits: int) -> DataFrame:
    """Keeps the pairs whose lines are within `edits` edits."""
    return distances(pairs, a, b, edits).filter("_distance is not null").drop("_distance")


def near_pairs(pairs: DataFrame, a: str, b: str, edits: int | None) -> DataFrame:
    """Keeps the pairs whose lines are within `edits` edits, or within those that the shorter one allows."""
    if edits is not None:
        return bit_parallel(pairs, a, b, edits)
    most = allowed(F.least(F.length(a), F.length(b)))
    some = pairs.filter(F.abs(F.length(a) - F.length(b)) <= most)
    return distances(some, a, b, MOST_EDITS, most).filter(F.col("_distance") <= most).drop("_distance")


def near_earlier(lines: DataFrame, edits: int | None) -> DataFrame:
    """(id) of the lines with an unequal line near them that stands earlier."""
    none = lines.sparkSession.createDataFrame([], "id long")
    one = even_members(one_edit_keys(lines) if edits is None else even_keys(lines, edits, F.lit(True)))
    more = staged(wide_members(lines.filter(F.col("size") >= 2 * CHARS_PER_EDIT)), "members") if edits is None else None
    ids = one.select("id") if more is None else one.select("id").union(more.select(F.shiftright("place", 10)))
    # only the lines that share a key are read from here on
    wanted = staged(ids.distinct(), "wanted")
    if wanted.isEmpty():
        return none
    known = lines.join(broadcast_if_small(wanted, WANTED_ROWS), "id", "left_semi")
    known = staged(known.select("id", F.struct(*AT).alias("at"), "line", "size"), "known")
    facts = known.select("id", "at", "size")
    if more is not None:
        members = by_length(staged(unpacked(more, known.select("id", "size")).join(facts, "id"), "members"), known)
        if not one.isEmpty():
            members = undivided(narrowed(one.join(facts, "id"), known), known).unionByName(members)
    else:
        one = one.join(facts, "id")
        members = undivided(narrowed(one, known) if edits == 1 else one, known)

    # a line comes once under a key for each pair of sides, held as a segment if it is so anywhere; members of a key are numbered in order
    members = members.groupBy("key", "id", "at", "size", *SIDES).agg(F.max("own").alias("own"))
    order = F.row_number().over(Window.partitionBy("key").orderBy("at"))
    members = staged(members.withColumn("n", order), "ranked")
    most = members.agg(F.max("n")).first()[0] or 0

    gone, open_lines, done, each = none, members, 0, 1
    while done < most - 1:
        # the next `each` members of a key lead, and are compared with those behind them
        leaders = members.filter((F.col("n") > done) & (F.col("n") <= done + each))
        leaders = leaders.select("key", F.col("id").alias("lead"), *compared(members, "_"))
        later = open_lines.filter(F.col("n") > done + 1).select("key", "id", *compared(members))
        met = later.join(leaders, "key").filter(f"n > _n and id <> lead and (own or _own) and {may_be_near(edits)}")
        met = staged(met.select("id", "lead").distinct(), "met")
        if not met.isEmpty():
            both = met.join(known.select("id", "line"), "id").join(known.select(F.col("id").alias("lead"), F.col("line").alias("other")), "lead")
            found = near_pairs(both, "line", "other", edits).select("id").distinct()
            gone = staged(gone.union(found), "gone")
        done, each = done + each, each * SMALL
        open_lines = members.filter(F.col("n") > done + 1).join(gone, "id", "left_anti")
    return gone


def duplicate_lines(docs: DataFrame, edits: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, _row, n_exact, n_near, removed) of the documents that lose lines; _row is the text's hash.

    A line of at least min_chars code points with a word goes if an equal line
    stands earlier in its document or in a document with a smaller doc_id
    (exact), or if a line within `edits` edits does (near; the places where the
    two stand first decide which is earlier: doc_id, then the line's number,
    then its hash where both stand at one number of rows with one doc_id).
    Without `edits`,
    the shorter of two lines gives their number: one for each CHARS_PER_EDIT
    characters, up to MOST_EDITS. removed holds the numbers of these lines,
    from 0, in order. Shorter lines stay.

    A null or empty text has one empty line, which stays. Rows that repeat a
    doc_id count as one document: a line of theirs is removed from neither row
    for the other's sake. Rows with a null doc_id count as one document that
    stands behind all others. Other columns are ignored. An empty table gives
    no rows.
    """
    base = id_text(docs)
    lines = staged(distinct_lines(base, min_chars), "lines")
    near = near_earlier(lines, edits).withColumn("near", F.lit(True))
    # decisions on lines that are not simply kept
    decided = lines.select("id", *ID, "unknown", "first", "n").join(near, "id", "left").filter("n > 1 or near")
    decided = staged(decided.select(*ID, "unknown", "first", F.coalesce("near", F.lit(False)).alias("near")), "decided")

    every = occurrences(base, min_chars, F.xxhash64("text").alias("_row")).select("doc_id", "_row", "pos", *line_id(F.col("line")))
    judged = salted_left_join(every, decided.withColumn("_known", F.lit(True)), ID, F.col("doc_id")).filter("_known")
    # one row for each line of a document, so that a line repeated in it comes once
    judged = judged.groupBy("doc_id", "_row", *ID, "unknown", "first", "near").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    again = F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0)))
    earlier = (F.col("first") < F.col("doc_id")) | (F.col("doc_id").isNull() & ~F.col("unknown"))
    exact = F.when(earlier, F.col("at")).otherwise(again)
    judged = judged.select("doc_id", "_row", exact.alias("exact"), F.when(F.col("near"), F.col("at")).otherwise(exact).alias("gone"))
    judged = judged.filter(F.size("gone") > 0).groupBy("doc_id", "_row")
    return judged.agg(
        F.sum(F.size("exact")).alias("n_exact"),
        F.sum(F.size("gone") - F.size("exact")).alias("n_near"),
        F.array_sort(F.flatten(F.collect_list("gone"))).alias("removed"),
    )


def deduplicate(docs: DataFrame, edits: int | None = None, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `removed`, `n_exact`, `n_near` and `cleaned`: the text without the lines that go.

    See duplicate_lines(). Texts with nothing to remove are returned as they
    are. The four columns take the place of columns of docs with their names.
    """
    flags = duplicate_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), edits, min_chars)
    flags = staged(flags.select(F.col("doc_id").alias("_id"), "_row", "n_exact", "n_near", "removed"), "flags")
    size = flags.agg(F.sum(F.size("removed") + F.lit(4))).first()[0] or 0
    own = ["removed", "n_exact", "n_near", "cleaned"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(*carried(docs, True, own), F.col(id_col).cast("long").alias("_i"), text.alias("_text")).withColumn("_r", F.xxhash64("_text"))
    flags = F.broadcast(flags) if size <= WANTED_ROWS else flags
    joined = given.join(flags, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_r") == F.col("_row")), "left")
    joined = joined.select("*", once(F.when(F.col("removed").isNotNull(), F.split("_text", "\n"))).alias("_lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "removed")
    left = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    return joined.select(
        "_given.*",
        "removed",
        F.coalesce("n_exact", F.lit(0)).alias("n_exact"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("removed").isNull(), F.col("_text")).otherwise(left).alias("cleaned"),
    )


def op6_line_dedup(spark, sf_dir):
    """(doc_id, n_lines, n_exact, n_near, cleaned_sha256) of every row of documents; see duplicate_lines() for odd input."""
    found = deduplicate(documents(spark, sf_dir).select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return found.select("doc_id", lines.cast("long").alias("n_lines"), F.col("n_exact").cast("long").alias("n_exact"), F.col("n_near").cast("long").alias("n_near"), F.sha2("cleaned", 256).alias("cleaned_sha256"))

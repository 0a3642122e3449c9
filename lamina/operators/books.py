"""Books as lines: stories, their title blocks, metadata, footnotes and bodies, found by machines that scan lines.

Lines are rows (book, n from 0 without gaps, line); windows look at most NEAR lines around, within blocks of lines that overlap
by as much, and what reaches further is a state of lamina.operators.scan, so that a book of any length is many tasks' work.
What segmented and reflow find of lines is held in pieces (scan.packed), and so is the text that it is joined to: a row has some thousand lines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import lines as L
from lamina.operators import evaluation as E
from lamina.operators import scan
from lamina.sources.scratch import stored

# What lines of the layout look like, and how far above its verse line a story's header may be.
WHITE = r"[ \t\f\r]"
HEADER = rf"^{WHITE}*(\d+)\.(\d+){WHITE}+([^ \t\f\r].*)$"
VERSES = rf"^{WHITE}*Dhp{WHITE}+(\d+)(?:{WHITE}*[-–—]{WHITE}*(\d+))?\.?{WHITE}*$"
FOOTER = rf"^{WHITE}*\d+\.{WHITE}+.+ - \d+{WHITE}*$"
PAGE_NUMBER = rf"^\f{WHITE}*\d{{1,4}}{WHITE}*$"
RATING = rf"^{WHITE}*(\*{{2,5}}){WHITE}*$"
KEYWORDS = rf"^{WHITE}*Keywords:"
CHAPTER = rf"^{WHITE}{{4,}}\d{{1,2}}\. The (?:Chapter about|Miscellaneous Chapter)\b"
CHAPTER_END = rf"vagga{WHITE}*$"
COLOPHON = rf"^{WHITE}*Conclusion, Nigamanakathā"
NOTE_NUMBER = rf"^{WHITE}*(\d{{1,3}}){WHITE}*$"
NOTE_BODY = rf"^{WHITE}+(?:(?:AJ|BG):|{WHITE}\p{{L}})"
BLANK = rf"^{WHITE}*$"
#: How each line begins that one of these is like, but for NOTE_BODY and CHAPTER_END.
MARKED = rf"^{WHITE}*(?:$|[\d*]|Dhp|Keywords:|Conclusion)"
#: Characters at a line's end before which a pattern's end may match, or which are white space to it.
WHITE_CHARS, TERMINATORS = list(" \t\f\r"), list("\n\r\x85\u2028\u2029")
NEAR = 8

#: What a line is to the machine, each alone or with the end of a chapter's heading on it (the number doubled, and one more).
KINDS = ["story", "verses", "rating", "keywords", "blank", "blank_without_rating", "note", "header", "chapter", "chapter_without_end", "colophon", "other"]
#: Where a line of a story is, without and with a footnote open from BODY on.
NONE, TITLE, META, KEYED = range(4)
ZONES = ["body", "heading", "preface", "colophon"]
STATES = 4 + 2 * len(ZONES)
PARTS = ["none", "title", "meta", "footnote", "rating", *ZONES]


def is_noise(line: Column) -> Column:
    """Running footers and page numbers of title pages."""
    return (F.contains(line, F.lit(" - ")) & line.rlike(FOOTER)) | (F.startswith(line, F.lit("\f")) & line.rlike(PAGE_NUMBER))


def _next(kind: str, ends: bool, state: int) -> int:
    """The machine: the next state for a line of this kind (ends: on which a chapter's heading ends)."""
    if kind == "story":
        return TITLE
    if kind == "verses":
        return META
    if state in (NONE, TITLE):
        return state
    if state in (META, KEYED):
        if kind == "rating" or (kind == "blank_without_rating" and state == KEYED):
            return 4
        return KEYED if kind == "keywords" else state
    zone, noted = ZONES[(state - 4) // 2], (state - 4) % 2
    if kind == "note":
        return 4 + 2 * ZONES.index(zone) + 1
    if noted and kind not in ("blank", "blank_without_rating", "header"):
        return state  # a footnote's own line
    if zone == "body":
        zone = {"chapter": "heading", "chapter_without_end": "preface", "colophon": "colophon"}.get(kind, zone)
    elif zone == "heading" and ends:
        zone = "preface"
    return 4 + 2 * ZONES.index(zone)


MACHINE = [[_next(k, e, s) for s in range(STATES)] for k in KINDS for e in (False, True)]
#: Read from the end: whether a rating (1) or the end of a chapter's heading (2) is still to come before the next story.
AHEAD = [[(0 if k == "story" else s | (k == "rating") | 2 * e) for s in range(4)] for k in KINDS for e in (False, True)]


def _looked_around(pieces: DataFrame, block: int) -> DataFrame:
    """book, n, upto and at of pieces with symbol: twice the number of each line's kind, and one more where a chapter's heading ends.

    Pieces are read in blocks of lines; those that have one of the NEAR lines on either side are copied into a block. A line of verses has its header above:
    blank lines first, then title lines. Of several verse lines below one header the last one counts.
    """
    wide = block * scan.WIDE
    own = F.floor(F.col("n") / wide).cast("long")
    sides = F.array_compact(F.array(own, F.when(F.col("n") % wide < NEAR, own - 1), F.when(F.col("upto") % wide >= wide - NEAR, own + 1)))
    spread = pieces.select("book", "n", "upto", "at", "flags", own.alias("_own"), F.explode(sides).alias("_block"))
    number = {k: 2 * i for i, k in enumerate(KINDS)}

    def looked(part: pa.Table) -> pa.Table:
        held = scan.Pieces(part)
        order = np.argsort(held.places, kind="stable")
        flags = held.values("flags").data[order]
        sign = flags & 3
        starts, verses = np.zeros(len(flags), bool), np.zeros(len(flags), bool)
        latest: dict[int, int] = {}
        for v in np.flatnonzero(flags & VERSES_FLAG).tolist():
            at, low = v - 1, max(0, v - NEAR)
            while at >= low and sign[at] == BLANK_SIGN:
                at -= 1
            while at >= low and sign[at] == OTHER_SIGN:
                at -= 1
            if at >= low and sign[at] == HEADER_SIGN:
                starts[at] = verses[v] = True
                if at in latest:
                    verses[latest[at]] = False
                latest[at] = v
        notes = ((flags & NUMBER_FLAG) > 0) & np.append((flags[1:] & NOTE_BODY_FLAG) > 0, False)
        early, late = (flags >> EARLY_SHIFT) & 3, flags >> LATE_SHIFT
        kinds = np.select(
            [starts, verses, early == 1, early == 2, sign == BLANK_SIGN, notes, sign == HEADER_SIGN, late == 1, late == 2],
            [number[k] for k in ("story", "verses", "rating", "keywords", "blank", "note", "header", "chapter", "colophon")], number["other"],
        )
        symbol = np.empty(len(flags), np.int32)
        symbol[order] = kinds + ((flags & ENDS_FLAG) > 0)
        mine = np.equal(part["_own"].to_numpy(), part["_block"].to_numpy())
        return held.table(["book", "n", "upto", "at"], {"symbol": symbol}, {"symbol": "byte"}).filter(pa.array(mine))

    return scan.dealt(spread, ["book", "_block"]).groupBy("book", "_block").applyInArrow(looked, f"book {pieces.schema['book'].dataType.simpleString()}, n long, upto long, at binary, symbol binary")


#: What a line is, as the bits of a number: its sign in the lowest two, and what it is like.
OTHER_SIGN, BLANK_SIGN, HEADER_SIGN = range(3)
VERSES_FLAG, NUMBER_FLAG, NOTE_BODY_FLAG, ENDS_FLAG, EARLY_SHIFT, LATE_SHIFT = 4, 8, 16, 32, 6, 8


def _flags(line: Column, marked: Column) -> Column:
    """What a line (not null) is like; marked: whether it is like MARKED, without which most patterns needn't be tried."""
    like = lambda pattern: marked & line.rlike(pattern)
    bit = lambda condition, value: F.when(condition, value).otherwise(0)
    indented = reduce(lambda a, b: a | b, [F.startswith(line, F.lit(x)) for x in WHITE_CHARS])
    sign = F.when(like(BLANK), BLANK_SIGN).when(like(HEADER), HEADER_SIGN).otherwise(OTHER_SIGN)
    early = F.when(like(RATING), 1 << EARLY_SHIFT).when(like(KEYWORDS), 2 << EARLY_SHIFT).otherwise(0)
    late = F.when(like(CHAPTER), 1 << LATE_SHIFT).when(like(COLOPHON), 2 << LATE_SHIFT).otherwise(0)
    number = ~F.startswith(line, F.lit("\f")) & like(NOTE_NUMBER)
    ends = F.contains(line, F.lit("vagga")) & line.rlike(CHAPTER_END)
    return sign + bit(like(VERSES), VERSES_FLAG) + bit(number, NUMBER_FLAG) + bit(indented & line.rlike(NOTE_BODY), NOTE_BODY_FLAG) + bit(ends, ENDS_FLAG) + early + late


def segmented(lines: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """book, n, line, story (n of the story's header), note (n of the line that opens the footnote) and part of each line of books.

    lines: book, n (from 0 without gaps), line; noise is taken out before they are numbered. A story begins at a header that is at most NEAR lines above a line of verses,
    with its title lines between. Metadata follow up to the rating; without one, up to the first blank line after the keywords. The body goes on to the next
    story, a chapter's heading or the colophon; what follows a heading is a preface. Footnotes are lines of their own
    wherever they stand. Parts: none, title, meta, rating, body, heading, preface, colophon, footnote.

    Defined cases: a null line is blank; a book without a story is all none; of several verse lines below one header the
    last one counts; a heading whose end never comes is one line (an end within a footnote
    counts as to come, and what follows the heading then stays heading);
    lines of any length are read as a whole; an empty table gives an empty result; other columns are ignored.
    """
    lines = lines.select("book", F.col("n").cast("long").alias("n"), F.coalesce("line", F.lit("")).alias("line"))
    lines = lines.withColumn("_marked", F.col("line").rlike(MARKED)).withColumn("flags", _flags(F.col("line"), F.col("_marked")).cast("short"))
    # windows and scans see what a line is, not the line
    flags = stored(scan.packed(lines, ["book"], "n", ["flags"], block), "lines")
    rows = stored(_looked_around(flags, block), "kinds")
    kind = {k: i for i, k in enumerate(KINDS)}

    def with_ahead(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        symbol, to_come = x["symbol"].data, x["before"]
        is_ = symbol // 2
        symbol = symbol + 2 * ((is_ == kind["blank"]) & (to_come & 1 == 0)) + 2 * ((is_ == kind["chapter"]) & (to_come & 2 == 0))
        return {"symbol": symbol, "story": np.ma.masked_array(x["n"], symbol >= 2), "note": np.ma.masked_array(x["n"], symbol // 2 != kind["note"])}

    ahead = scan.states(rows, ["book"], "n", "symbol", AHEAD, backward=True, block=block, derived=({"symbol": "byte", "story": "long", "note": "long"}, with_ahead))

    def parted(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        before, after = x["before"], x["after"]
        zone, was = (after - 4) // 2, (before - 4) // 2
        noted = (after >= 4) & (after % 2 == 1)
        rated = (before < 4) & (x["symbol"].data // 2 == kind["rating"])
        heading = (zone == 1) | ((zone == 2) & (was < 2))
        names = ["none", "title", "meta", "footnote", "rating", "heading"]
        part = np.select([after == NONE, after == TITLE, after < 4, noted, rated, heading], [PARTS.index(p) for p in names], len(PARTS) - len(ZONES) + zone)
        last = x["last_note"]
        return {"story": x["last_story"], "note": np.ma.masked_array(last.data, np.ma.getmaskarray(last) | ~noted), "part": part}

    found = scan.states(stored(ahead, "kinds"), ["book"], "n", "symbol", MACHINE, ["story", "note"], block=block, derived=({"story": "long", "note": "long", "part": "byte"}, parted))

    def unpacked(text: pa.Table, found: pa.Table) -> pa.Table:
        """The lines of a block with what was found of them, which may have been cut into other pieces."""
        texts, place = scan.Pieces(text), scan.Pieces(found)
        at, order = np.argsort(texts.places, kind="stable"), np.argsort(place.places, kind="stable")
        story, note, part = (place.values(c)[order] for c in ("story", "note", "part"))
        columns = [pa.array(np.ma.getdata(x), mask=np.ma.getmaskarray(x)) for x in (story, note)]
        names = pa.DictionaryArray.from_arrays(part.data, pa.array(PARTS)).cast(pa.string())
        lines = texts.texts("line")
        lines = lines if (np.diff(at) == 1).all() else lines.take(pa.array(at))
        return pa.Table.from_arrays([pa.repeat(text["book"][0], len(at)), pa.array(texts.places[at]), lines, *columns, names], ["book", "n", "line", "story", "note", "part"])

    out = f"book {lines.schema['book'].dataType.simpleString()}, n long, line string, story long, note long, part string"
    own = F.floor(F.col("n") / block).cast("long").alias("_block")
    texts = scan.packed(lines, ["book"], "n", ["line"], block).select("book", own, "n", "at", "line")
    return texts.groupBy("book", "_block").cogroup(found.select("book", own, "n", "at", "story", "note", "part").groupBy("book", "_block")).applyInArrow(unpacked, out)


def _with_lines(found: DataFrame, lines: DataFrame) -> DataFrame:
    """found with the columns that lines (book, n and more) has besides: the one time that a line's text is shuffled to what was found of it."""
    texts = lines.select(F.col("book").alias("_b"), F.col("n").alias("_n"), *[c for c in lines.columns if c not in found.columns])
    return found.join(texts, found["book"].eqNullSafe(texts["_b"]) & (found["n"] == texts["_n"])).drop("_b", "_n")


# The labels of metadata, in the layout's order, and how a footnote names its author.
LABELS = {"cst4": "CST4", "burlingame": "Burlingame", "compare": "Compare", "cast": "Cast", "keywords": "Keywords"}
LABEL = rf"^{WHITE}*(CST4|Burlingame|Compare|Cast|Keywords):{WHITE}*(.*)$"
NOTE_AUTHOR = rf"^{WHITE}*(?:(AJ|BG):)?{WHITE}*(.*)$"


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, as a lambda's variable, however often f names it."""
    return F.transform(F.array(value), f)[0]


def wrapped(parts: Column) -> Column:
    """Lines (an array) as one text: joined by a space, or by nothing after a hyphen behind a letter. Blank lines drop out."""
    edged = lambda x: F.substring(x, 1, 1).isin(WHITE_CHARS) | F.substring(x, -1, 1).isin(WHITE_CHARS + TERMINATORS)
    bare = F.filter(F.transform(parts, lambda x: F.when(edged(x), F.regexp_replace(x, rf"^{WHITE}+|{WHITE}+$", "")).otherwise(x)), lambda x: x != "")
    joined = lambda x: F.when(F.contains(x, F.lit("-\n")), F.regexp_replace(x, "(\\p{L})-\n", "$1-")).otherwise(x)
    return F.replace(_once(F.array_join(bare, "\n"), joined), F.lit("\n"), F.lit(" "))


def _in_order(condition: Column, value: Column) -> Column:
    """The values of a group's rows that meet the condition, in the order of n."""
    rows = F.sort_array(F.collect_list(F.when(condition, F.struct("n", value.alias("v")))))
    return F.transform(rows, lambda x: x["v"])


def metadata(parts: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """book, story and the fields of each story's metadata: the labels' values, synopsis and rating. parts: as segmented returns them.

    A label's value goes on in the next lines while it ends with a comma; of a label that comes twice the last value counts. All
    other lines are the synopsis.

    Defined cases: a field that isn't there is null; an empty one is empty; a blank line or the rating ends a value; a story without metadata has only nulls.
    """
    rows = parts.where("part in ('meta', 'rating')").select("book", "n", "line", "story", "part")
    text = F.regexp_replace("line", rf"^{WHITE}+|{WHITE}+$", "")
    rows = rows.withColumns({"text": text, "label": F.regexp_extract("line", LABEL, 1)})
    plain = (text == "") | (F.col("part") == "rating") | F.col("line").rlike(VERSES)
    # a value is open (1) behind a line of it that ends with a comma
    comma = F.endswith(F.when(F.col("label") != "", F.regexp_extract("text", LABEL, 2)).otherwise(F.col("text")), F.lit(","))
    symbol = F.when(plain, 0).when(F.col("label") != "", F.when(comma, 1).otherwise(0)).when(comma, 2).otherwise(0)
    rows = stored(rows.withColumns({"symbol": symbol, "plain": plain, "opens": F.when(F.col("label") != "", F.col("n"))}), "metadata")
    found = scan.states(rows, ["book"], "n", "symbol", [[0, 0], [1, 1], [0, 1]], ["opens"], block=block)
    goes_on = (F.col("before") == 1) & (F.col("label") == "") & ~F.col("plain")
    run = F.when((F.col("label") != "") | goes_on, F.col("last_opens"))
    value = F.when(F.col("label") != "", F.regexp_extract("text", LABEL, 2)).otherwise(F.col("text"))
    found = found.select("book", "story", "n", run.alias("run"), "label", value.alias("value"), (F.col("plain") | run.isNotNull()).alias("known"), F.when(F.col("part") == "rating", F.length("text")).alias("rating"))
    values = found.where("run is not null").groupBy("book", "story", "run").agg(F.max("label").alias("label"), wrapped(_in_order(F.lit(True), F.col("value"))).alias("value"))
    fields = values.groupBy("book", "story").agg(*[F.max_by("value", F.when(F.col("label") == label, F.col("run"))).alias(name) for name, label in LABELS.items()])
    lines = found.groupBy("book", "story").agg(
        F.nullif(wrapped(_in_order(~F.col("known"), F.col("value"))), F.lit("")).alias("synopsis"), F.max("rating").cast("long").alias("rating"), F.max("n").alias("last")
    )
    fields = fields.select(F.col("book").alias("_book"), F.col("story").alias("_story"), *LABELS)
    same = lines["book"].eqNullSafe(fields["_book"]) & (lines["story"] == fields["_story"])
    return lines.join(fields, same, "left").select("book", "story", *LABELS, "synopsis", "rating")


def titles(parts: DataFrame) -> DataFrame:
    """book, story, group_id, first_verse, last_verse, title and second_title (the last line of a title block of two lines or more)."""
    block = parts.where("part = 'title'").groupBy("book", "story").agg(_in_order(~F.col("line").rlike(BLANK), F.regexp_replace("line", rf"^{WHITE}+|{WHITE}+$", "")).alias("t"))
    first = parts.where("part = 'meta'").where(F.col("line").rlike(VERSES)).groupBy(F.col("book").alias("_book"), F.col("story").alias("_story")).agg(F.min_by("line", "n").alias("verses"))
    rows = block.join(first, block["book"].eqNullSafe(first["_book"]) & (block["story"] == first["_story"]))
    head = [F.regexp_extract(F.col("t")[0], HEADER, i) for i in (1, 2, 3)]
    a, b = (F.regexp_extract("verses", VERSES, i) for i in (1, 2))
    n = F.size("t")
    return rows.select(
        "book", "story", F.concat(head[0], F.lit("."), head[1]).alias("group_id"), a.cast("long").alias("first_verse"), F.coalesce(F.nullif(b, F.lit("")), a).cast("long").alias("last_verse"),
        F.array_join(F.concat(F.array(head[2]), F.slice("t", 2, F.greatest(n - 2, F.lit(0)))), " ").alias("title"), F.when(n > 1, F.element_at("t", -1)).alias("second_title"),
    )


def footnotes(parts: DataFrame) -> DataFrame:
    """book, story (in whose lines it is printed), note (n of its first line), marker, author (AJ, BG or unlabeled) and text of each footnote."""
    rows = parts.where("part = 'footnote'").groupBy("book", "story", "note").agg(_in_order(F.lit(True), F.col("line")).alias("t"))
    head = [F.regexp_extract(F.col("t")[1], NOTE_AUTHOR, i) for i in (1, 2)]
    return rows.select(
        "book", "story", "note", F.regexp_extract(F.col("t")[0], NOTE_NUMBER, 1).alias("marker"), F.coalesce(F.nullif(head[0], F.lit("")), F.lit("unlabeled")).alias("author"),
        wrapped(F.concat(F.array(head[1]), F.slice("t", 3, F.greatest(F.size("t"), F.lit(1))))).alias("text"),
    )


#: A footnote's number in running text, as lamina.functions.lines.without_marks takes it out.
MARK = rf"{L.BEFORE_MARK}(\d{{1,3}}){L.AFTER_MARK}"


def _marks(parts: DataFrame, which: Column) -> DataFrame:
    """book, story and each number that may be a footnote's in lines of these parts."""
    return parts.where(which).select("book", "story", F.explode(F.regexp_extract_all("line", F.lit(MARK), F.lit(1))).alias("marker")).distinct()


def returned(parts: DataFrame, notes: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """notes (as footnotes returns them) with home, the story that each belongs to.

    A footnote is printed at the foot of the page that its number is on, and so now and then among the lines of the story before
    or after. In the order of stories, a story whose text has a number without a footnote of it takes the footnote of its neighbour before, or else
    of the one behind, unless that one's text has the number too. What a story takes depends on what its neighbours took before:
    that is a state of a machine that goes over the stories of each book and number. Footnotes of the colophon's numbers are left out.

    Defined cases: a number that no neighbour's text has leaves its footnote where it is; several footnotes of one number in a
    story move together; a null book is a book; without footnotes the result is empty.
    """
    stories = E.numbered(parts.where("story is not null").select("book", "story").distinct(), ["book"], ["story"]).select("book", "story", F.col("i").alias("k"))
    stories = stored(stories, "stories")
    left = _marks(parts, F.col("part") == "colophon")
    gone = left.select(F.col("book").alias("_b"), F.col("story").alias("_s"), F.col("marker").alias("_m"))
    notes = notes.join(gone, notes["book"].eqNullSafe(gone["_b"]) & (notes["story"] == gone["_s"]) & (notes["marker"] == gone["_m"]), "left_anti")
    place = stories.select(F.col("book").alias("_b"), F.col("story").alias("_s"), "k")

    def at_k(rows: DataFrame) -> DataFrame:
        return rows.join(place, rows["book"].eqNullSafe(place["_b"]) & (rows["story"] == place["_s"])).drop("_b", "_s")

    notes = stored(at_k(notes), "notes")
    text = F.col("part").isin("title", "body") | ((F.col("part") == "meta") & ~F.col("line").rlike(KEYWORDS))
    found = at_k(_marks(parts, text)).select("book", "k", "marker", F.lit(0).alias("has"), F.lit(1).alias("found"))
    both = notes.select("book", "k", "marker", F.lit(1).alias("has"), F.lit(0).alias("found")).union(found)
    both = stored(both.groupBy("book", "k", "marker").agg(F.max("has").alias("has"), F.max("found").alias("found")), "marks")
    rows = both
    for name, by in (("prev", 1), ("next", -1)):
        other = both.select(F.col("book").alias("_b"), (F.col("k") + by).alias("_k"), F.col("marker").alias("_m"), F.col("has").alias(f"has_{name}"), F.col("found").alias(f"found_{name}"))
        rows = rows.join(other, rows["book"].eqNullSafe(other["_b"]) & (rows["k"] == other["_k"]) & (rows["marker"] == other["_m"]), "left").drop("_b", "_k", "_m")
    bits = ["has", "found", "has_prev", "found_prev", "has_next", "found_next"]
    symbol = sum((F.coalesce(b, F.lit(0)) * 2**i for i, b in enumerate(bits)), F.lit(0)) + F.when(F.col("has_prev").isNull(), 64).otherwise(0)
    rows = rows.select("book", "marker", "k", symbol.alias("symbol"))

    def takes(symbol: int, state: int) -> int:
        """1: the footnote of the story before, 2: of the one behind, 0: none. state: 1 if the story's own was taken, 2 if that of the story before was."""
        has, found, has_prev, found_prev, has_next, found_next, alone = ((symbol >> i) & 1 for i in range(7))
        state = 0 if alone else state
        if not found or (has and not state & 1):
            return 0
        if has_prev and not found_prev and not state & 2:
            return 1
        return 2 if has_next and not found_next else 0

    table = [[(takes(x, s) == 2) + 2 * (s & 1 if x < 64 else 0) for s in range(4)] for x in range(128)]
    found = scan.states(stored(rows, "marks"), ["book", "marker"], "k", "symbol", table, block=block)
    choice = F.array(*[F.lit(takes(x, s)) for x in range(128) for s in range(4)])
    found = found.withColumn("took", choice[F.col("symbol") * 4 + F.col("before")]).where("took > 0")
    # a move's source is next to its target, and each footnote moves once at most
    moves = found.select(F.col("book").alias("_b"), F.col("marker").alias("_m"), (F.col("k") + F.when(F.col("took") == 1, -1).otherwise(1)).alias("_k"), F.col("k").alias("to"))
    notes = notes.join(moves, notes["book"].eqNullSafe(moves["_b"]) & (notes["k"] == moves["_k"]) & (notes["marker"] == moves["_m"]), "left").drop("_b", "_k", "_m")
    notes = notes.withColumn("to", F.coalesce("to", "k"))
    homes = stories.select(F.col("book").alias("_b"), F.col("k").alias("_k"), F.col("story").alias("home"))
    return notes.join(homes, notes["book"].eqNullSafe(homes["_b"]) & (notes["to"] == homes["_k"])).select("book", "story", "note", "marker", "author", "text", "home")


# Words of the translation that the original never has, letters that only the original has, widths and signs of the layout.
ENGLISH = """the and of is with through like one not by at for who he she it that this his her their was were are to in on as if but so
from which when where how what why then than or an a i we you they them its our your no all has have do does did will would can could may might
those these without into should be been whose""".split()
MARKED_LETTERS = "āīūṁṅñṭḍṇḷṛśṣ"
SHORT, VERSE_LINE, FULL_LINE, INDENTED = 62, 55, 60, 3
SENTENCE_END, RUNS_ON = r"[.!?:;”’)–]$", r"[.,;:!?–—’”]$"
NUMBERED = r"^\s*(\d{1,3})\.\s+(\S.*)$"


def language(line: Column) -> Column:
    """english, pali or unknown: whether more words are English function words or hold a marked letter."""
    low = F.lower(line)
    words = F.regexp_extract_all(low, F.lit(r"(\p{L}+)"), F.lit(1))
    marked = lambda x: x.rlike(f"[{MARKED_LETTERS}]")
    # as variables of lambdas, words are taken out and counted once
    counts = F.transform(F.array(words), lambda ws: F.struct(F.size(F.filter(ws, lambda w: w.isin(ENGLISH))).alias("e"), F.when(marked(low), F.size(F.filter(ws, marked))).otherwise(0).alias("p")))
    return F.transform(counts, lambda c: F.when((c["e"] == 0) & (c["p"] == 0), "unknown").when(c["p"] > c["e"], "pali").otherwise("english"))[0]


def _without_crumbs(x: Column) -> Column:
    """Without form feeds and page numbers in brackets."""
    found = reduce(lambda a, b: a | b, [F.contains(x, F.lit(sign)) for sign in "\f{["])
    return F.when(found, F.regexp_replace(F.replace(x, F.lit("\f"), F.lit("")), L.PAGE_CRUMB, "")).otherwise(x)


def _without_end(x: Column) -> Column:
    """Without white space at the end."""
    found = reduce(lambda a, b: a | b, [F.endswith(x, F.lit(sign)) for sign in [*WHITE_CHARS, "\x0b", *TERMINATORS]])
    return F.when(found, F.regexp_replace(x, r"\s+$", "")).otherwise(x)


def _with_single_spaces(x: Column) -> Column:
    """With one space at most within; the indent stays."""
    single = F.concat(F.regexp_extract(x, "^( *)", 1), F.regexp_replace(F.regexp_replace(x, "^ +", ""), " {2,}", " "))
    return F.when(F.contains(F.ltrim(x), F.lit("  ")), single).otherwise(x)


#: The steps of tidy. Patterns are tried only on texts with a sign that they need.
TIDY = [_without_crumbs, _without_end, _with_single_spaces]


def tidy(line: Column) -> Column:
    """A line without form feeds, page numbers in brackets, white space at its end and more than one space within; its indent stays."""
    return reduce(_once, TIDY, line)


def _body(parts: DataFrame) -> DataFrame:
    """book, story, n, line (tidy), bare (without its indent), indent and indented of the lines of bodies that aren't blank."""
    rows = parts.where("part = 'body'").select("book", "story", "n", "line")
    # a column for each step, which is compiled, as a lambda isn't; a filter in place of the explode would be worked out on its own, all steps again
    for step in TIDY:
        rows = rows.withColumn("line", step(F.col("line")))
    rows = rows.select("book", "story", "n", F.explode(F.when(F.col("line") != "", F.array("line"))).alias("line"))
    rows = rows.withColumn("bare", F.ltrim("line"))
    return rows.withColumn("indent", F.length("line") - F.length("bare")).withColumn("indented", F.col("indent") >= INDENTED)


def _ends_in(line: Column, pattern: str, signs: str) -> Column:
    """line.rlike(pattern), for a pattern of one of the signs at the end."""
    return F.substring(line, -1, 1).isin([*signs, *TERMINATORS]) & line.rlike(pattern)


def reflow(parts: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """book, story, first_line (its n), kind (paragraph or verse) and text of each block of each story's body.

    Wrapped lines are joined to paragraphs, which end behind a sentence that ends early, or before verse or another indent; verse
    lines (indented, and short, numbered or in the original's language) stay lines. Whether a paragraph is open is a state of a machine over the lines; the line behind is
    what a scan from the end carries along.

    Defined cases: blank lines are no lines; the last line of a story ends its paragraph; a story without a body has no rows; a block of any
    length is one row, as its text is.
    """
    size = F.length("bare")
    # a line's language counts only where it is indented (an open verse line is, and the line that it runs on to has the same indent) and of some length
    tongue = F.when(F.col("indented") & (size >= min(VERSE_LINE, FULL_LINE)), language(F.col("bare")))
    rows = _body(parts).withColumn("tongue", tongue)
    verse = F.col("indented") & ((size < VERSE_LINE) | F.col("bare").rlike(NUMBERED) | (F.col("tongue") == "pali"))
    full = F.col("indented") & (size >= FULL_LINE) & (F.col("tongue") != "pali")
    packed = F.col("indent") * 8 + F.when(verse, 4).otherwise(0) + F.when(F.col("indented"), 2).otherwise(0) + F.when(full, 1).otherwise(0)
    bits = [_ends_in(F.col("bare"), RUNS_ON, ".,;:!?–—’”"), _ends_in(F.col("bare"), SENTENCE_END, ".!?:;”’)–"), size < F.lit(SHORT) - F.col("indent")]
    flags = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(bits)), F.lit(0))
    rows = rows.select("book", "story", "n", "bare", packed.cast("long").alias("packed"), flags.cast("byte").alias("flags"))
    body = stored(scan.packed(rows, ["book"], "n", ["story", "packed", "flags", "bare"], block), "body")

    def looked_behind(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        own, flags, none = x["packed"].data, x["flags"].data, np.ma.getmaskarray(x["prior_story"])
        last = np.where(none | x["story"].mask, none != x["story"].mask, x["prior_story"].data != x["story"].data)
        behind = x["prior_packed"].data
        opens = ~last & (flags & 1 == 0) & (behind >> 3 == own >> 3) & (behind & 1 == 1)
        alone = (own & 4 > 0) & ~opens
        ends = last | ((flags & 2 > 0) & ((behind & 4 > 0) | ((behind & 2) != (own & 2)) | (flags & 4 > 0)))
        return {"symbol": alone * 4 + ends * 2 + last}

    rows = body.select("book", "n", "upto", "at", "story", "packed", "flags")
    rows = scan.states(rows, ["book"], "n", "flags", [[0]] * 8, ["packed", "story"], backward=True, block=block, derived=({"symbol": "byte"}, looked_behind))

    def after(alone: int, ends: int, last: int, state: int) -> int:
        """0: nothing is open, 1: a paragraph, 2: a verse."""
        if alone and state != 1:
            return 0 if last else 2
        return 0 if ends else 1

    def begun(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        before = x["before"]
        kept = (x["symbol"].data >= 4) & (before != 1)
        return {"kept": kept, "start": np.ma.masked_array(x["n"], before == np.where(kept, 2, 1))}

    table = [[after(x >> 2, (x >> 1) & 1, x & 1, s) for s in range(3)] for x in range(8)]
    rows = scan.states(stored(rows, "symbols"), ["book"], "n", "symbol", table, block=block, derived=({"kept": "byte", "start": "long"}, begun))
    named = ({"kept": "byte", "first_line": "long", "follows": "byte"}, lambda x: {"kept": x["kept"], "first_line": x["last_start"], "follows": x["follows"]})
    rows = scan.states(stored(rows, "blocks"), ["book"], "n", "kept", [[0]] * 2, ["start"], block=block, derived=named)

    def gathered(whole: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
        """The lines of each block in a piece, as far as they follow one another: of those blocks that are whole in it, or of the others."""

        def of_piece(text: pa.Table, found: pa.Table) -> pa.Table:
            lines, place = scan.Pieces(text), scan.Pieces(found)
            first, story, follows = place.values("first_line").data, lines.values("story"), place.values("follows").data
            at = np.append(0, np.flatnonzero((np.diff(first) != 0) | (follows[1:] == 0)) + 1)
            bare = pa.ListArray.from_arrays(pa.array(np.append(at, len(first)).astype(np.int32)), lines.texts("bare"))
            kept = pa.array(np.maximum.reduceat(place.values("kept").data, at), pa.int32())
            stories = pa.array(story.data[at], pa.int64(), mask=np.ma.getmaskarray(story)[at])
            # its first line is here, and so is the line right behind it, which is another block's
            ended = np.append((follows[at[1:]] == 1) & (np.diff(first[at]) != 0), False)
            chosen = pa.array(((lines.places[at] == first[at]) & ended) == whole)
            return pa.Table.from_arrays([pa.repeat(text["book"][0], len(at)), stories, pa.array(first[at]), pa.array(lines.places[at]), kept, bare], ["book", "story", "first_line", "n", "kept", "lines"]).filter(chosen)

        return of_piece

    out = f"book {parts.schema['book'].dataType.simpleString()}, story long, first_line long, n long, kept int, lines array<string>"
    # the texts are shuffled to what was found of them, and only those of blocks on two pieces once more
    both = body.select("book", "n", "at", "story", "bare").groupBy("book", "n").cogroup(rows.groupBy("book", "n"))
    cut = both.applyInArrow(gathered(False), out).groupBy("book", "story", "first_line").agg(F.max("kept").alias("kept"), F.flatten(_in_order(F.lit(True), F.col("lines"))).alias("lines"))
    blocks = both.applyInArrow(gathered(True), out).select("book", "story", "first_line", "kept", "lines").union(cut)
    text = F.when(F.col("kept") == 1, F.array_join("lines", "\n")).otherwise(wrapped(F.col("lines")))
    return blocks.select("book", "story", "first_line", F.when(F.col("kept") == 1, "verse").otherwise("paragraph").alias("kind"), text.alias("text"))


def verses(parts: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """book, story, number, original and translation of the first verse of its own that each story's body quotes in full.

    The original begins at a numbered line in its language whose number is among the story's; it goes on while lines are indented,
    not numbered and not English, and the translation while they are indented and not in the original's language.

    Defined cases: a story that quotes none of its verses has no row; no translation: null; numbers are those of the story's own verse line.
    """
    rows = _body(parts).withColumn("tongue", F.when(F.col("indented"), language(F.col("bare"))))
    own = titles(parts).select(F.col("book").alias("_b"), F.col("story").alias("_s"), "first_verse", "last_verse")
    number = F.nullif(F.regexp_extract("line", NUMBERED, 1), F.lit("")).cast("long")
    tail = F.regexp_extract("line", NUMBERED, 2)
    inner = F.length(F.regexp_replace(tail, r"[^\p{L}]", ""))
    marked = F.length(F.regexp_replace(F.lower(tail), f"[^{MARKED_LETTERS}]", ""))
    rows = rows.withColumns({"number": number, "pali_like": (inner >= 8) & (marked > F.lit(0.1) * inner)})
    heads = rows.where("number is not null and pali_like").select("book", "story", "n", "number")
    heads = heads.join(own, heads["book"].eqNullSafe(own["_b"]) & (heads["story"] == own["_s"])).where("number between first_verse and last_verse")
    heads = heads.select(F.col("book").alias("_b"), F.col("n").alias("_n"))
    rows = rows.join(heads, rows["book"].eqNullSafe(heads["_b"]) & (rows["n"] == heads["_n"]), "left").withColumn("match", F.col("_n").isNotNull()).drop("_b", "_n")
    first = parts.where("n = story").select("book", "story", "n", F.lit(5).alias("symbol"), F.lit(None).cast("string").alias("bare"), F.lit(None).cast("long").alias("number"))
    goes_on = F.col("indented") & F.col("number").isNull() & (F.col("tongue") != "english")
    translates = F.col("indented") & (F.col("tongue") != "pali")
    symbol = F.when(F.col("match"), F.when(translates, 1).otherwise(0)).otherwise(F.when(goes_on & translates, 2).when(goes_on, 3).when(translates, 4).otherwise(6))
    tail_or_all = F.when(F.col("match"), tail).otherwise(F.col("bare"))
    rows = rows.select("book", "story", "n", symbol.alias("symbol"), tail_or_all.alias("head"), "bare", "number")
    texts = stored(rows.unionByName(first.withColumn("head", F.col("bare"))), "verses")
    rows = texts.select("book", "story", "n", "symbol")

    def after(symbol: int, state: int) -> int:
        """0: no verse yet, 1: the original, 2: the translation, 3: behind it. A story's first line (5) begins anew."""
        if symbol == 5:
            return 0
        if state == 0:
            return int(symbol in (0, 1))
        if state == 1 and symbol in (2, 3):
            return 1
        return 2 if state < 3 and symbol in (1, 2, 4) else 3

    rows = scan.states(rows, ["book"], "n", "symbol", [[after(x, s) for s in range(4)] for x in range(7)], block=block).where("after in (1, 2)")
    rows = _with_lines(rows.select("book", "story", "n", "before", "after"), texts.select("book", "n", "head", "bare", "number"))
    original = F.when(F.col("before") == 0, F.col("head")).otherwise(F.col("bare"))
    grouped = rows.groupBy("book", "story").agg(
        F.max(F.when(F.col("before") == 0, F.col("number"))).alias("number"), F.array_join(_in_order(F.col("after") == 1, original), " ").alias("original"),
        F.nullif(F.array_join(_in_order(F.col("after") == 2, F.col("bare")), " "), F.lit("")).alias("translation"),
    )
    return grouped

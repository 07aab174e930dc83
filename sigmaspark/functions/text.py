"""Names, paths and small text formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARTIST_BYTES, TITLE_BYTES = 60, 120


def present(col: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(col, F.lit(""))


def sanitize_filename(col: Column) -> Column:
    """Control characters and the nine reserved ones become ``_``; spaces and dots go at the ends; nothing left is ``untitled``."""
    safe = F.regexp_replace(col, r'[\x01-\x1F/\\:*?"<>|]', "_")
    bare = F.regexp_replace(F.regexp_replace(safe, r"^[ .]+", ""), r"[ .]+$", "")
    return F.when(col.isNotNull(), F.coalesce(present(bare), F.lit("untitled")))


def sanitize_filepath(col: Column) -> Column:
    """As a file name, but separators and colons stay; dots and white space go at the ends of the whole path."""
    safe = F.regexp_replace(col, r'[\x01-\x1F\x7F"*<>?|]', "_")
    return F.regexp_replace(F.regexp_replace(safe, r"^[. \t\r\n]+", ""), r"[. \t\r\n]+$", "")


def cut_bytes(col: Column, limit: int) -> Column:
    """The longest prefix of at most ``limit`` UTF-8 bytes that doesn't split a character."""
    raw = F.encode(col, "utf-8")
    # A character begins at a byte that doesn't continue one (80 to BF): the cut is moved back to there.
    ends = F.sequence(F.lit(limit), F.lit(limit - 3), F.lit(-1))
    starts = F.filter(ends, lambda n: ~F.hex(F.substring(raw, n + 1, F.lit(1))).rlike("^[89AB]"))
    whole = F.decode(F.substring(raw, F.lit(1), F.get(starts, F.lit(0))), "utf-8")
    return F.when(F.octet_length(col) <= limit, col).otherwise(whole)


def first_token(col: Column, limit: int = ARTIST_BYTES) -> Column:
    """Up to the first of ``;``, ``/``, ``,`` or `` - ``, without trailing spaces, cut to a number of bytes."""
    return cut_bytes(F.rtrim(F.split(col, ";|/|,| - ", 2)[0]), limit)


def best_artist(performer: Column, album_artist: Column) -> Column:
    return F.coalesce(present(performer), present(album_artist))


def track_filename(number: Column, title: Column, performer: Column | None = None, album_artist: Column | None = None) -> Column:
    """``NN - Artist - Title``, or what there is of it; without title and performer arguments' values ``NN - Track n``."""
    nn = F.format_string("%02d", number)
    name = sanitize_filename(cut_bytes(present(title), TITLE_BYTES))
    who = F.lit(None).cast("string")
    if performer is not None:
        who = sanitize_filename(first_token(best_artist(performer, album_artist if album_artist is not None else F.lit(None).cast("string"))))
    rest = F.coalesce(name, who, F.concat(F.lit("Track "), number.cast("string")))
    rest = F.when(name.isNotNull() & who.isNotNull(), F.concat_ws(" - ", who, name)).otherwise(rest)
    return F.concat_ws(" - ", nn, rest)


def _album(title: Column, artist: Column) -> Column:
    who = sanitize_filename(first_token(present(artist)))
    name = sanitize_filename(cut_bytes(present(title), TITLE_BYTES))
    return F.coalesce(present(F.concat_ws(" - ", who, name)), F.lit("Unknown Album"))


def album_dir(title: Column, artist: Column, disc: Column, discs: Column) -> Column:
    return F.when((discs > 1) & (disc > 0), F.format_string("%s (disc %d-%d)", _album(title, artist), disc, discs)).otherwise(_album(title, artist))


def album_path(title: Column, artist: Column, disc: Column, discs: Column) -> Column:
    return F.when((discs > 1) & (disc > 0), F.format_string("%s/Disc %d", _album(title, artist), disc)).otherwise(_album(title, artist))


def input_type(path: Column) -> Column:
    """What a path is read as: ``network``, ``device``, ``dsf``, ``dsdiff`` or ``sacd``."""
    low = F.lower(path)
    return (
        F.when(path.rlike(r"^[^/]*\.[^/]*:[0-9]+$"), "network")
        .when(path.startswith("/dev/"), "device")
        .when(low.rlike(r"\.dsf$"), "dsf")
        .when(low.rlike(r"\.(dff|dsdiff)$"), "dsdiff")
        .otherwise("sacd")
    )


def isrc(country: Column, owner: Column, year: Column, code: Column) -> Column:
    """Twelve characters, or empty if country and owner are."""
    return F.when((F.coalesce(country, F.lit("")) == "") & (F.coalesce(owner, F.lit("")) == ""), "").otherwise(
        F.concat(F.rpad(country, 2, " "), F.rpad(owner, 3, " "), F.lpad(year, 2, "0"), F.lpad(code, 5, "0"))
    )


def _leading(col: Column) -> Column:
    """The integer that a text begins with, after white space; 0 if there is none."""
    return F.coalesce(F.regexp_extract(col, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def parse_date(col: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of ``YYYY[-MM[-DD]]``; 0 where unknown. A month needs seven characters, a day ten."""
    size = F.octet_length(col)
    dash = lambda at: F.substring(col, at, 1) == "-"
    has_month = (size >= 7) & dash(5)
    month = F.when(has_month, _leading(F.substring(col, 6, 5)))
    day = F.when(has_month & (size >= 10) & dash(8), _leading(F.substring(col, 9, 5)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return zero(F.when(size >= 4, _leading(col))), zero(month), zero(day)


def parse_of(col: Column) -> tuple[Column, Column]:
    """Number and total of ``n`` or ``n/total``; 0 where unknown. The total is what follows the first slash, whatever comes before it."""
    return _leading(F.coalesce(col, F.lit(""))), F.when(F.instr(col, "/") > 0, _leading(F.substring_index(F.substr(col, F.instr(col, "/") + 1), "/", 1))).otherwise(F.lit(0))


def cue_escape(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def synchsafe(value: Column) -> Column:
    """An integer of 28 bits as four bytes of 7 bits each, read as one integer."""
    return sum((F.shiftleft(F.shiftright(value, 7 * k).bitwiseAND(127), 8 * k) for k in range(1, 4)), value.bitwiseAND(127))


def from_synchsafe(value: Column) -> Column:
    return sum((F.shiftleft(F.shiftright(value, 8 * k).bitwiseAND(127), 7 * k) for k in range(1, 4)), value.bitwiseAND(127))

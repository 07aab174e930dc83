"""Names of codes and codes of names, as column expressions over literal maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What formats, layouts and tag frames are called.
FRAME_FORMATS = {"dsd": "DSD", "dst": "Lossless DST", "int16": "PCM 16-bit", "int24": "PCM 24-bit", "int32": "PCM 32-bit", "float32": "PCM Float32", "float64": "PCM Float64"}
SPEAKERS = {1: "Mono", 2: "Stereo", 3: "3ch", 4: "4ch", 5: "5ch", 6: "5.1ch"}
AREA_SPEAKERS = {(2, 0): "2.0 Stereo", (5, 3): "5.0 Surround", (6, 4): "5.1 Surround"}
AREA_FORMATS = {0: "DST", 2: "DSD (3-in-14)", 3: "DSD (3-in-16)"}
OUTPUTS = {"dsf": "DSF", "dsdiff": "DSDIFF", "em": "DSDIFF Edit Master", "wav": "WAV", "flac": "FLAC", "xml": "XML Metadata", "cue": "CUE Sheet", "print": "Text Metadata"}
OUTPUT_NAMES = {
    "dsf": "dsf", "dsdiff": "dsdiff", "dff": "dsdiff", "em": "em", "edit-master": "em", "editmaster": "em", "master": "em", "wav": "wav", "wave": "wav",
    "flac": "flac", "xml": "xml", "cue": "cue", "cuesheet": "cue", "print": "print", "text": "print", "txt": "print",
}
EXTENSIONS = {"dsf": ".dsf", "dsdiff": ".dff", "em": ".dff", "wav": ".wav", "flac": ".flac", "xml": ".xml", "cue": ".cue", "print": ".txt"}
QUALITIES = {"fast": "fast", "normal": "normal", "standard": "normal", "high": "high", "best": "high"}
TRACK_FORMATS = {"number": "number", "num": "number", "title": "title", "num-title": "title", "artist": "artist", "num-artist-title": "artist"}
TAG_FRAMES = {
    "TIT2": "Title", "TPE1": "Artist", "TPE2": "Album Artist", "TALB": "Album", "TCOM": "Composer", "TEXT": "Lyricist", "TCON": "Genre", "TRCK": "Track", "TPOS": "Disc",
    "TDRC": "Recording Date", "TYER": "Year", "TSRC": "ISRC", "TPUB": "Publisher", "TCOP": "Copyright", "TXXX": "User Text", "COMM": "Comment", "APIC": "Picture",
    "TLEN": "Length", "TBPM": "BPM", "TKEY": "Key", "TLAN": "Language", "TCMP": "Compilation", "TSOP": "Performer Sort", "TSOA": "Album Sort", "TSOT": "Title Sort",
    "TSO2": "Album Artist Sort", "WOAR": "Artist URL", "WOAS": "Source URL", "WPUB": "Publisher URL",
}


def _named(col: Column, names: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), col)


def named(code: Column, names: dict) -> Column:
    """The name of a code; ``Unknown`` for one without a name."""
    return F.coalesce(_named(code, names), F.lit("Unknown"))


def frame_format(code: Column) -> Column:
    return named(code, FRAME_FORMATS)


def speakers(channels: Column) -> Column:
    return named(channels.cast("int"), SPEAKERS)


def area_speakers(channels: Column, config: Column) -> Column:
    """A disc area's layout, which takes both the channel count and the loudspeaker code."""
    out = F.lit("Unknown")
    for (n, code), name in AREA_SPEAKERS.items():
        out = F.when((channels == n) & (config == code), name).otherwise(out)
    return out


def area_format(code: Column) -> Column:
    return named(code.cast("int"), AREA_FORMATS)


def parse_output(name: Column) -> Column:
    """An output format by any of its names, in any case; null for another."""
    return _named(F.lower(name), OUTPUT_NAMES)


def output_name(output: Column) -> Column:
    return named(output, OUTPUTS)


def extension(output: Column) -> Column:
    return F.coalesce(_named(output, EXTENSIONS), F.lit(""))


def parse_quality(name: Column) -> Column:
    return _named(F.lower(name), QUALITIES)


def parse_track_format(name: Column) -> Column:
    return _named(F.lower(name), TRACK_FORMATS)


def tag_frame_name(frame: Column) -> Column:
    """The name of a tag frame by its first four letters; an unknown one keeps its id, null is unknown."""
    return F.coalesce(_named(F.left(frame, F.lit(4)), TAG_FRAMES), frame, F.lit("Unknown"))


def in_name_list(name: Column, names: Column) -> Column:
    """Whether the first entry of a comma list that matches takes the name: names match in any case, ``ALL`` matches every name, and ``-`` before an entry refuses it."""
    entries = F.split(names, ",")
    bare = F.transform(entries, lambda e: F.regexp_replace(e, "^-", ""))
    hit = F.transform(bare, lambda e: (F.lower(e) == F.lower(name)) | (e == "ALL"))
    at = F.array_position(hit, F.lit(True))
    return F.coalesce((at > 0) & ~F.get(entries, (at - 1).cast("int")).startswith("-"), F.lit(False))


def lists_meet(a: Column, b: Column, separator: str = ",") -> Column:
    """Whether two lists have an entry in common; empty entries don't count."""
    own = F.filter(F.split(a, separator), lambda x: x != "")
    return F.coalesce(F.arrays_overlap(own, F.split(b, separator)), F.lit(False))

"""Gain-map metadata as XMP text, written and read with string functions only."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute names of the format, our names and the defaults where an attribute is missing; the last one must be there.
FIELDS = [
    ("GainMapMin", "gain_map_min", 0.0), ("GainMapMax", "gain_map_max", 1.0), ("Gamma", "gamma", 1.0), ("OffsetSDR", "offset_sdr", 0.015625),
    ("OffsetHDR", "offset_hdr", 0.015625), ("HDRCapacityMin", "hdr_capacity_min", 0.0), ("HDRCapacityMax", "hdr_capacity_max", None),
]
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
HEAD = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:hdrgm="http://ns.adobe.com/hdr-gain-map/1.0/"'
TAIL = "</rdf:Description></rdf:RDF></x:xmpmeta>"
CONTAINER = ' xmlns:Container="http://ns.google.com/photos/1.0/container/" xmlns:Item="http://ns.google.com/photos/1.0/container/item/"'
ITEM = '<rdf:li rdf:parseType="Resource"><Container:Item Item:Semantic="{}" Item:Mime="image/jpeg"'


def escaped(text: Column) -> Column:
    for plain, entity in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def number(value: Column) -> Column:
    """Six decimals: the same text everywhere."""
    return F.format_string("%.6f", value)


def primary(second_length: Column, version: Column) -> Column:
    """The packet of the first picture: the directory of both, with the bytes of the second."""
    items = ITEM.format("Primary") + "/></rdf:li>" + ITEM.format("GainMap") + ' Item:Length="'
    return F.concat(F.lit(HEAD + CONTAINER + ' hdrgm:Version="'), escaped(version), F.lit('"><Container:Directory><rdf:Seq>' + items), second_length.cast("string"),
                    F.lit('"/></rdf:li></rdf:Seq></Container:Directory>' + TAIL))


def secondary(values: dict[str, Column], version: Column) -> Column:
    """The packet of the map. values: by our names, a number or an array of three, which counts as its mean."""
    parts = [F.lit(HEAD + ' hdrgm:Version="'), escaped(version), F.lit('"')]
    for name, ours, _ in FIELDS:
        parts += [F.lit(f' hdrgm:{name}="'), number(values[ours]), F.lit('"')]
    return F.concat(*parts, F.lit(' hdrgm:BaseRenditionIsHDR="False">' + TAIL))


def mean_of(three: Column) -> Column:
    return F.aggregate(three, F.lit(0.0), lambda a, x: a + x) / F.size(three)


#: Markup and the text between it; name="value" pairs inside of markup.
PIECES = r"<[^<>]*>|[^<>]+"
PAIRS = r"""([A-Za-z][\w.:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')"""
PACKET = r"(?s)<x:xmpmeta\b.*?</x:xmpmeta>"
PREFIX = "hdrgm:"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body speaks of it: a Column in a plan is text, repeated wherever it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bared(text: Column) -> Column:
    """Without the blanks around it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def properties(packet: Column) -> Column:
    """An array of (name, value) of a packet's gain-map properties, names in lower case without their prefix: its attributes, and every text that stands
    inside of an element of that prefix, so a list gives one of each item. One pass over the pieces of markup, which remembers the open element."""
    ours = F.lower(F.lit(PREFIX))
    entry = "array<struct<name:string,value:string>>"

    def seen(state, piece):
        tag = F.lower(F.regexp_extract(piece, r"^</?\s*([^\s/>]+)", 1))
        closes, alone = F.startswith(piece, F.lit("</")), F.endswith(piece, F.lit("/>"))
        own = F.startswith(tag, ours)
        names, plain, quoted = (F.regexp_extract_all(piece, F.lit(PAIRS), F.lit(k)) for k in (1, 2, 3))
        pairs = F.zip_with(names, F.zip_with(plain, quoted, lambda a, b: F.concat(a, b)), lambda n, v: F.struct(F.lower(n).alias("name"), v.alias("value")))
        bare = lambda x: F.struct(F.substr(x["name"], F.lit(len(PREFIX) + 1)).alias("name"), x["value"].alias("value"))
        attributes = F.transform(F.filter(pairs, lambda x: F.startswith(x["name"], ours)), bare)
        text = bared(piece)
        is_tag = F.startswith(piece, F.lit("<"))
        inner = F.when((state.open != "") & (text != ""), F.array(F.struct(state.open.alias("name"), text.alias("value")))).otherwise(F.array().cast(entry))
        opened = F.when(~is_tag | ~own | alone, state.open).when(closes, F.lit("")).otherwise(F.substr(tag, F.lit(len(PREFIX) + 1)))
        return F.struct(opened.alias("open"), F.concat(state.found, F.when(is_tag, attributes).otherwise(inner)).alias("found"))

    start = F.struct(F.lit("").alias("open"), F.array().cast(entry).alias("found"))
    return F.aggregate(F.regexp_extract_all(packet, F.lit(PIECES), F.lit(0)), start, seen)["found"]


def values_of(found: Column, name: str) -> Column:
    return F.transform(F.filter(found, lambda x: x["name"] == name.lower()), lambda x: bared(x["value"]))


def parsed(text: Column) -> Column:
    """A struct of the map's parameters, arrays of three but for the capacities; null if no packet of the text has a version and a largest capacity, of
    which the first counts. Three values are those of the channels, one is that of all of them; what is no number counts as missing."""
    packets = F.transform(F.regexp_extract_all(text, F.lit(PACKET), F.lit(0)), properties)
    first = lambda found, name: F.get(F.filter(values_of(found, name), lambda v: v != ""), F.lit(0))
    good = F.filter(packets, lambda found: first(found, "Version").isNotNull() & first(found, "HDRCapacityMax").isNotNull())

    def channels(p, name, default):
        def three(numbers):
            one = F.coalesce(F.get(numbers, F.lit(0)), F.lit(default))
            return F.when(F.size(numbers) == 3, F.transform(numbers, lambda v: F.coalesce(v, F.lit(default)))).otherwise(F.array(one, one, one))

        return let(F.transform(values_of(p, name), lambda v: v.try_cast("double")), three)

    def fields(p):
        capacities = [F.coalesce(first(p, name).try_cast("double"), F.lit(default)).alias(ours) for name, ours, default in FIELDS[5:]]
        return F.struct(*(channels(p, name, default).alias(ours) for name, ours, default in FIELDS[:5]), *capacities)

    return F.get(F.transform(F.slice(good, 1, 1), fields), F.lit(0))

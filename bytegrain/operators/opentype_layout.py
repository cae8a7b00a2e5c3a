"""Layout and variation tables of OpenType, as the public specification lays them out: GSUB, GPOS, GDEF, BASE, item variation stores, HVAR,
VVAR, MVAR, STAT and gvar, with the sub-tables that they share.

Offsets count from the table that holds them, which is a view; zero means that nothing is there.
"""

from __future__ import annotations

from ..functions import expr as X
from ..functions import pattern as P
from . import combinators as C
from . import format as N

V = X.var
u8, u16, u32, i8, i16, i32 = C.u8, C.u16be, C.u32be, C.i8, C.i16be, C.i32be


def fields(f: N.Format, *names: str) -> list[tuple[str, N.Format]]:
    return [(name, f) for name in names]


def counted(f: N.Format, count: str = "count", name: str = "items", width: N.Format = u16) -> N.Format:
    return C.record((count, width), (name, C.repeat_count(V(count), f)))


def linked(offset: N.Format, view: str, f: N.Format) -> N.Format:
    """What an offset from a view leads to; zero leads nowhere."""
    there = N.LiftedOption(C.parse_from_view(view, f, V("_to")))
    return C.chain(offset, "_to", N.Match(V("_to").eq(0), ((P.boolean(True), N.LiftedOption(None)), (P.boolean(False), there))))


def at(view: str, f: N.Format) -> N.Format:
    """A table that its own offsets count from."""
    return C.let_view(view, f)


def by_format(kinds: dict[int, N.Format]) -> N.Format:
    """A table whose first number names its format; an unknown one keeps that number."""
    cases = [(P.integer(k), N.Variant(f"format-{k}", f)) for k, f in kinds.items()]
    return C.chain(u16, "_format", N.Match(V("_format"), (*cases, (P.wildcard(), N.Variant("unknown", C.compute(V("_format")))))))


def coverage() -> N.Format:
    span = C.record(*fields(u16, "first", "last", "index"))
    return by_format({1: counted(u16), 2: counted(span)})


def classes() -> N.Format:
    span = C.record(*fields(u16, "first", "last", "class"))
    return by_format({1: C.record(("first", u16), ("classes", counted(u16))), 2: counted(span)})


def device() -> N.Format:
    """Adjustments by size, packed in words, or a place in an item variation store."""
    per_word = X.match(V("format"), (P.integer(1), 8), (P.integer(2), 4), (P.wildcard(), 2))
    words = C.repeat_count((V("last") - V("first") + 1 + X.cast("u16", per_word) - 1) // X.cast("u16", per_word), u16)
    sized = N.Match(V("format"), ((P.between(1, 3), N.Variant("deltas", words)), (P.wildcard(), N.Variant("variation", C.compute(X.none())))))
    return C.record(("first", u16), ("last", u16), ("format", u16), ("data", sized))


def value(form: X.Expr) -> N.Format:
    """Placements and advances that a format's bits name, and their devices."""
    names = ("x-placement", "y-placement", "x-advance", "y-advance")
    parts = [(k, C.cond_maybe((form & (1 << i)).ne(0), i16)) for i, k in enumerate(names)]
    parts += [(f"{k}-device", C.cond_maybe((form & (1 << (4 + i))).ne(0), linked(u16, "sub", device()))) for i, k in enumerate(names)]
    return C.record(*parts)


def anchor() -> N.Format:
    place = fields(i16, "x", "y")
    return at("anchor", by_format({1: C.record(*place), 2: C.record(*place, ("point", u16)), 3: C.record(*place, *[(k, linked(u16, "anchor", device())) for k in ("x-device", "y-device")])}))


# Contexts


def _action() -> N.Format:
    return C.record(*fields(u16, "sequence", "lookup"))


def _rule() -> N.Format:
    return C.record(("n-input", u16), ("n-actions", u16), ("input", C.repeat_count(V("n-input") - 1, u16)), ("actions", C.repeat_count(V("n-actions"), _action())))


def _chained_rule() -> N.Format:
    return C.record(("before", counted(u16)), ("n-input", u16), ("input", C.repeat_count(V("n-input") - 1, u16)), ("after", counted(u16)), ("actions", counted(_action())))


def _rules(rule: N.Format) -> N.Format:
    return counted(linked(u16, "sub", at("set", counted(linked(u16, "set", rule)))))


def _covered(*more: tuple[str, N.Format]) -> N.Format:
    return C.record(("coverage", linked(u16, "sub", coverage())), *more)


def context() -> N.Format:
    covers = C.record(("n-input", u16), ("n-actions", u16), ("input", C.repeat_count(V("n-input"), linked(u16, "sub", coverage()))), ("actions", C.repeat_count(V("n-actions"), _action())))
    return by_format({1: _covered(("rules", _rules(_rule()))), 2: _covered(("classes", linked(u16, "sub", classes())), ("rules", _rules(_rule()))), 3: covers})


def chained_context() -> N.Format:
    covers = lambda: counted(linked(u16, "sub", coverage()))
    by_class = [(k, linked(u16, "sub", classes())) for k in ("before-classes", "input-classes", "after-classes")]
    whole = C.record(("before", covers()), ("input", covers()), ("after", covers()), ("actions", counted(_action())))
    return by_format({1: _covered(("rules", _rules(_chained_rule()))), 2: _covered(*by_class, ("rules", _rules(_chained_rule()))), 3: whole})


# Lookups


def substitutions() -> dict[int, N.Format]:
    """Sub-tables of GSUB by the lookup's type; 7 is made of the others."""
    sequence = counted(u16)
    ligature = C.record(("glyph", u16), ("count", u16), ("components", C.repeat_count(V("count") - 1, u16)))
    many = _covered(("sequences", counted(linked(u16, "sub", sequence))))
    covers = lambda: counted(linked(u16, "sub", coverage()))
    return {
        1: by_format({1: _covered(("delta", i16)), 2: _covered(("glyphs", counted(u16)))}),
        2: by_format({1: many}),
        3: by_format({1: many}),
        4: by_format({1: _covered(("sets", counted(linked(u16, "sub", at("set", counted(linked(u16, "set", ligature)))))))}),
        5: context(),
        6: chained_context(),
        8: by_format({1: _covered(("before", covers()), ("after", covers()), ("glyphs", counted(u16)))}),
    }


def positions() -> dict[int, N.Format]:
    """Sub-tables of GPOS by the lookup's type; 9 is made of the others."""
    one, two = V("value-format"), V("second-format")
    pair = C.record(("second", u16), ("first-value", value(one)), ("second-value", value(two)))
    formats = fields(u16, "value-format", "second-format")
    cell = C.record(("first-value", value(one)), ("second-value", value(two)))
    by_class = _covered(*formats, *[(k, linked(u16, "sub", classes())) for k in ("first-classes", "second-classes")], ("n-first", u16), ("n-second", u16), ("rows", C.repeat_count(V("n-first"), C.repeat_count(V("n-second"), cell))))
    ends = C.record(*[(k, linked(u16, "sub", anchor())) for k in ("entry", "exit")])
    marks = at("marks", counted(C.record(("class", u16), ("anchor", linked(u16, "marks", anchor())))))
    row = C.repeat_count(V("n-classes"), linked(u16, "bases", anchor()))
    bases = at("bases", counted(row))
    ligatures = at("set", counted(linked(u16, "set", at("bases", counted(row)))))

    def attached(base: str, array: N.Format) -> N.Format:
        return by_format({1: C.record(("mark-coverage", linked(u16, "sub", coverage())), (f"{base}-coverage", linked(u16, "sub", coverage())), ("n-classes", u16), ("marks", linked(u16, "sub", marks)), (base, linked(u16, "sub", array)))})

    return {
        1: by_format({1: _covered(("value-format", u16), ("value", value(one))), 2: _covered(("value-format", u16), ("values", counted(value(one))))}),
        2: by_format({1: _covered(*formats, ("sets", counted(linked(u16, "sub", at("sub", counted(pair)))))), 2: by_class}),
        3: by_format({1: _covered(("records", counted(ends)))}),
        4: attached("bases", bases),
        5: attached("ligatures", ligatures),
        6: attached("bases", bases),
        7: context(),
        8: chained_context(),
    }


def lookup(kinds: dict[int, N.Format], extension: int) -> N.Format:
    """A lookup with its sub-tables; those of an extension lie further away and say their type themselves."""

    def subtable(kind: X.Expr, more: tuple = ()) -> N.Format:
        cases = [(P.integer(k), N.Variant(f"type-{k}", f)) for k, f in kinds.items()]
        return at("sub", N.Match(kind, (*cases, *more, (P.wildcard(), N.Variant("unknown", C.compute(kind))))))

    far = C.record(("__format", C.where(u16, lambda x: x.eq(1))), ("type", u16), ("subtable", linked(u32, "sub", subtable(V("type")))))
    one = subtable(V("type"), ((P.integer(extension), N.Variant("extension", far)),))
    return at("lookup", C.record(("type", u16), ("flag", u16), ("subtables", counted(linked(u16, "lookup", one))), ("mark-set", C.cond_maybe((V("flag") & 0x10).ne(0), u16))))


# Variations


def variation_store() -> N.Format:
    axis = C.record(*fields(i16, "start", "peak", "end"))
    regions = C.record(("n-axes", u16), ("count", u16), ("regions", C.repeat_count(V("count"), C.repeat_count(V("n-axes"), axis))))
    words, wide = V("word-count") & 0x7FFF, (V("word-count") & 0x8000).ne(0)
    row = C.match(wide, (P.boolean(False), C.record(("words", C.repeat_count(words, i16)), ("bytes", C.repeat_count(V("n-regions") - words, i8)))), (P.boolean(True), C.record(("words", C.repeat_count(words, i32)), ("bytes", C.repeat_count(V("n-regions") - words, i16)))))
    data = C.record(("count", u16), ("word-count", u16), ("n-regions", u16), ("region-indices", C.repeat_count(V("n-regions"), u16)), ("rows", C.repeat_count(V("count"), row)))
    return at("store", C.record(("__format", C.where(u16, lambda x: x.eq(1))), ("regions", linked(u32, "store", regions)), ("data", counted(linked(u32, "store", data)))))


def index_map() -> N.Format:
    size = ((V("entry-format") >> 4) & 3) + 1
    count = C.match(V("format"), (P.integer(0), C.map_format(u16, lambda n: X.cast("u32", n))), (P.wildcard(), u32))
    return C.record(("format", u8), ("entry-format", u8), ("count", count), ("entries", C.repeat_count(V("count"), C.repeat_count(size, u8))))


def metrics_variations(*maps: str) -> N.Format:
    """HVAR and VVAR."""
    return C.record(("major", u16), ("minor", u16), ("store", linked(u32, "table", variation_store())), *[(k, linked(u32, "table", index_map())) for k in maps])


def mvar() -> N.Format:
    record = C.record(("tag", C.fixed_ascii(4)), *fields(u16, "outer", "inner"))
    return C.record(*fields(u16, "major", "minor", "reserved", "record-size", "count"), ("store", linked(u16, "table", variation_store())), ("records", C.repeat_count(V("count"), record)))


def stat() -> N.Format:
    axis = C.record(("tag", C.fixed_ascii(4)), *fields(u16, "name-id", "order"))
    named = fields(u16, "axis", "flags", "name-id")
    kinds = {
        1: C.record(*named, ("value", i32)), 2: C.record(*named, *fields(i32, "nominal", "min", "max")), 3: C.record(*named, *fields(i32, "value", "linked")),
        4: C.record(("n-axes", u16), *fields(u16, "flags", "name-id"), ("values", C.repeat_count(V("n-axes"), C.record(("axis", u16), ("value", i32))))),
    }
    values = at("values", C.repeat_count(V("n-values"), linked(u16, "values", by_format(kinds))))
    head = fields(u16, "major", "minor", "axis-size", "n-axes")
    return C.record(*head, ("axes", linked(u32, "table", C.repeat_count(V("n-axes"), axis))), ("n-values", u16), ("values", linked(u32, "table", values)), ("fallback-name", C.cond_maybe(V("minor").gt(0), u16)))


def gvar() -> N.Format:
    """Shared tuples, and of each glyph its tuples' headers and the bytes of their points and deltas."""
    tuple_of = C.repeat_count(V("n-axes"), i16)
    flag = lambda bit: (V("index") & bit).ne(0)
    header = C.record(("size", u16), ("index", u16), ("peak", C.cond_maybe(flag(0x8000), tuple_of)), ("start", C.cond_maybe(flag(0x4000), tuple_of)), ("end", C.cond_maybe(flag(0x4000), tuple_of)))
    glyph = C.record(("tuple-count", u16), ("data-offset", u16), ("tuples", C.repeat_count(V("tuple-count") & 0x0FFF, header)), ("data", C.opaque_bytes()))
    low = C.match(V("flags") & 1, (P.integer(0), C.map_format(u16, lambda n: X.cast("u32", n) * 2)), (P.wildcard(), u32))
    here, size = V("offsets").at(V("_i")), V("offsets").at(V("_i") + 1) - V("offsets").at(V("_i"))
    one = N.Match(size.eq(0), ((P.boolean(True), N.LiftedOption(None)), (P.boolean(False), N.LiftedOption(C.parse_from_view("table", C.slice_of(size, glyph), V("glyphs-offset") + here)))))
    return C.record(
        *fields(u16, "major", "minor", "n-axes", "n-shared"), ("shared", linked(u32, "table", C.repeat_count(V("n-shared"), tuple_of))), ("n-glyphs", u16), ("flags", u16), ("glyphs-offset", u32), ("offsets", C.repeat_count(X.cast("u32", V("n-glyphs")) + 1, low)),
        ("glyphs", C.for_each(X.enum_from_to(0, V("n-glyphs")), "_i", one)),
    )


# Definitions and baselines


def gdef() -> N.Format:
    points = counted(u16)
    attachments = at("list", C.record(("coverage", linked(u16, "list", coverage())), ("points", counted(linked(u16, "list", points)))))
    caret = at("caret", by_format({1: C.record(("x", i16)), 2: C.record(("point", u16)), 3: C.record(("x", i16), ("device", linked(u16, "caret", device())))}))
    ligature = at("set", counted(linked(u16, "set", caret)))
    carets = at("list", C.record(("coverage", linked(u16, "list", coverage())), ("ligatures", counted(linked(u16, "list", ligature)))))
    sets = at("list", C.record(("__format", u16), ("sets", counted(linked(u32, "list", coverage())))))
    later = V("minor")
    return C.record(
        ("major", u16), ("minor", u16), ("glyph-classes", linked(u16, "table", classes())), ("attachments", linked(u16, "table", attachments)), ("carets", linked(u16, "table", carets)), ("mark-classes", linked(u16, "table", classes())),
        ("mark-sets", C.cond_maybe(later.gte(2), linked(u16, "table", sets))), ("variations", C.cond_maybe(later.gte(3), linked(u32, "table", variation_store()))),
    )


def base() -> N.Format:
    place = at("place", by_format({1: C.record(("at", i16)), 2: C.record(("at", i16), ("glyph", u16), ("point", u16)), 3: C.record(("at", i16), ("device", linked(u16, "place", device())))}))
    ends = [(k, linked(u16, "extent", place)) for k in ("min", "max")]
    extent = at("extent", C.record(*ends, ("features", counted(C.record(("tag", C.fixed_ascii(4)), *ends)))))
    values = at("values", C.record(("default", u16), ("places", counted(linked(u16, "values", place)))))
    script = at("script", C.record(("values", linked(u16, "script", values)), ("extent", linked(u16, "script", extent)), ("languages", counted(C.record(("tag", C.fixed_ascii(4)), ("extent", linked(u16, "script", extent)))))))
    scripts = at("list", counted(C.record(("tag", C.fixed_ascii(4)), ("script", linked(u16, "list", script)))))
    axis = at("axis", C.record(("tags", linked(u16, "axis", counted(C.fixed_ascii(4)))), ("scripts", linked(u16, "axis", scripts))))
    return C.record(("major", u16), ("minor", u16), ("horizontal", linked(u16, "table", axis)), ("vertical", linked(u16, "table", axis)), ("variations", C.cond_maybe(V("minor").gt(0), linked(u32, "table", variation_store()))))

"""Schemas that drift from file to file: what changed, and one table of all of it.

Fields of consecutive files of a feed are profiled (kinds, sketches of values, names). Lines of the two files that
hold the same record are paired by values that stand once in either file; fields that are gone and fields that are new
are matched as a bipartite graph by how often their values agree on paired lines.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftmill.session import broadcast_if_small, materialise

#: The payload's own fields, in order; fixed values.
PAYLOAD = (
    "point_id", "dn_no", "record_id", "grain_type", "text_content", "class_type", "lot_id", "product_id", "platform", "station", "machine", "scan_time",
    "total_wafers", "scanned_wafers", "bad_wafers", "defect_type", "edx_elements", "edx_bg", "map_location", "dft_location",
)
#: Part of the paired lines on which values must agree for a rename.
AGREE = 0.5
#: Without paired lines: part of the sketched values two fields must share.
ALIKE = 0.6
#: Values kept for a field's sketch: those of the least hashes.
SKETCH = 64
#: What parts the leaves of a field that came as a list; ``；`` where nothing else is said.
SEPARATORS = {"edx_elements": "/", "edx_bg": "/"}
REPORT = "feed string, file_name string, change string, field_name string, former_name string"


def kind_of(type_: Column) -> Column:
    """JSON kind of a variant's type name; NULL for JSON null, which tells none."""
    return (
        F.when(type_ == "VOID", None)
        .when(type_ == "STRING", "string")
        .when(type_ == "BIGINT", "integer")
        .when(type_ == "BOOLEAN", "boolean")
        .when(type_.startswith("ARRAY"), "list")
        .when(type_.startswith("OBJECT"), "object")
        # 25.0 keeps no decimals but isn't a BIGINT; whole numbers beyond one have more digits.
        .when(type_.rlike(r"^DECIMAL\((19|[23]\d),0\)"), "integer")
        .otherwise("fraction")
    )


def with_bare_value(rows: DataFrame, kind: str, text: str, out: str) -> DataFrame:
    """``rows`` with what stays of a value when its type and layout change: letters and digits of its leaves, numbers
    without trailing zeros, booleans as 1 and 0. ``text`` is the value as it is written. Each step is a projection of its
    own: what a step names twice isn't computed twice."""
    k, t = F.col(kind), F.col(text)
    nested = F.regexp_replace(F.regexp_replace(t, r'"(?:[^"\\]|\\.)*":', ""), r"\\u[0-9a-f]{4}|\\.", "")
    rows = rows.withColumn("__i", F.when(k.isin("list", "object"), nested).otherwise(t))
    i = F.col("__i")
    number = (F.length(i) < 32) & i.rlike(r"^-?\d+\.\d+$")
    rows = rows.withColumn("__i", F.when(number, F.regexp_replace(i, r"\.?0+$", "")).otherwise(i))
    rows = rows.withColumn("__w", F.regexp_replace(F.lower("__i"), r"[^\p{L}\p{N}]+", ""))
    w = F.col("__w")
    return rows.withColumn(out, F.when(k == "integer", t).when(w == "true", "1").when(w == "false", "0").otherwise(w))


def file_order(lines: DataFrame) -> DataFrame:
    """``(feed, file_name, no)``: files of a feed by ``exported_at`` (NULL first), then name."""
    files = lines.groupBy("feed", "file_name").agg(F.min("exported_at").alias("at"))
    return files.select("feed", "file_name", F.row_number().over(W.partitionBy("feed").orderBy(F.asc_nulls_first("at"), "file_name")).alias("no"))


def cells(lines: DataFrame) -> DataFrame:
    """``(feed, file_name, line_no, field, kind, h)``: one row a top-level field of each line that is a JSON object.

    Broken, blank and foreign lines (no object, a field twice) give nothing. ``h`` is the hash of the bare value; it
    and ``kind`` are NULL for JSON null.
    """
    spark = lines.sparkSession
    parsed = lines.select("feed", "file_name", "line_no", F.try_parse_json(F.col("raw")).alias("v"))
    parsed = parsed.where(F.schema_of_variant("v").startswith("OBJECT"))
    open_ = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    # Each step has its own projection: what is costly is computed once.
    typed = open_.select("feed", "file_name", "line_no", F.col("key").alias("field"), F.schema_of_variant("value").alias("__t"), F.col("value").cast("string").alias("__s"))
    kinds = with_bare_value(typed.withColumn("kind", kind_of(F.col("__t"))), "kind", "__s", "__b")
    return kinds.select("feed", "file_name", "line_no", "field", "kind", F.when(F.col("kind").isNotNull(), F.xxhash64("__b")).alias("h"))


def _words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+", name)]


def name_likeness(a: str, b: str) -> float:
    """0 to 1: shared letter pairs of two names, whatever their case and joints."""
    x, y = "".join(_words(a)), "".join(_words(b))
    if x == y:
        return 1.0
    p, q = ([s[i : i + 2] for i in range(len(s) - 1)] for s in (x, y))
    if not p or not q:
        return 0.0
    return 2 * sum(min(p.count(g), q.count(g)) for g in set(p)) / (len(p) + len(q))


def assignment(cost: list[list[float]]) -> list[int]:
    """The column of each row in the cheapest matching of a matrix with no more rows than columns."""
    n, m = len(cost), len(cost[0]) if cost else 0
    inf = float("inf")
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = [inf] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            delta, j1 = inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    reduced = cost[owner[j0] - 1][j - 1] - u[owner[j0]] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _score(gone: str, new: str, both: int, equal: int, shared: float, known: bool) -> float:
    """How likely a new field is a gone one under another name; 0 if it isn't."""
    likeness = name_likeness(gone, new)
    if both:
        return equal / both + 0.05 * likeness if equal / both >= AGREE else 0.0
    # No record in both files holds the two: the sketches and names decide.
    if known:
        return 0.6 * shared + 0.4 * likeness if shared >= ALIKE else 0.0
    return likeness if likeness >= 0.9 else 0.0


def _pairs(score: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """The matching of greatest total score; fields that no score ties are matched apart."""
    home: dict[tuple[int, str], tuple[int, str]] = {}

    def root(x: tuple[int, str]) -> tuple[int, str]:
        while home.setdefault(x, x) != x:
            x = home[x]
        return x

    for a, b in score:
        home[root((0, a))] = root((1, b))
    parts: dict[tuple[int, str], list[tuple[str, str]]] = {}
    for p in sorted(score):
        parts.setdefault(root((0, p[0])), []).append(p)
    out = []
    for part in parts.values():
        rows, cols = sorted({a for a, _ in part}), sorted({b for _, b in part})
        # As many empty columns as rows: a row may stay alone.
        cost = [[-score.get((a, b), 0.0) for b in cols] + [0.0] * len(rows) for a in rows]
        out += [(rows[i], cols[j]) for i, j in enumerate(assignment(cost)) if j < len(cols) and (rows[i], cols[j]) in score]
    return out


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of each file, from its candidate pairs and its gone, new and retyped fields."""
    for batch in batches:
        out = []
        for feed, name, items in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            gone = {i["gone"]: i["kind"] for i in items if i["what"] == "removed"}
            new = {i["new"]: i["kind"] for i in items if i["what"] == "added"}
            rows, cols = sorted(gone), sorted(new)
            score = {(i["gone"], i["new"]): _score(i["gone"], i["new"], i["both"], i["equal"], i["shared"], i["known"]) for i in items if i["what"] == "pair"}
            pairs = _pairs({p: v for p, v in score.items() if v > 0})
            found = [("retyped", i["new"], "") for i in items if i["what"] == "retyped"]
            found += [("renamed", b, a) for a, b in pairs]
            found += [("retyped", b, "") for a, b in pairs if gone[a] and new[b] and gone[a] != new[b]]
            found += [("removed", a, "") for a in rows if a not in {p[0] for p in pairs}]
            found += [("added", b, "") for b in cols if b not in {p[1] for p in pairs}]
            out += [(feed, name, *f) for f in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(5)], ["feed", "file_name", "change", "field_name", "former_name"])


def schema_changes(lines: DataFrame) -> DataFrame:
    """``(feed, file_name, change, field_name, former_name)``: each change of a top-level field against the file before.

    ``lines(feed, file_name, exported_at, line_no, raw)``; further columns aren't read. The first file of a feed has no
    changes. A field in any line is in the file; its kind is the most frequent one but NULL (of equals the first by
    name), and fields of which either file has only NULLs aren't retyped. A renamed field whose kind is another as well
    has two rows. Files without any object line have no fields. Repeated lines change nothing but frequencies.
    NULL feeds are one feed; lines without a file name aren't read. An empty table gives none.
    """
    base = lines.where(F.col("file_name").isNotNull()).select(F.coalesce("feed", F.lit("")).alias("feed"), "file_name", "exported_at", "line_no", "raw")
    order = materialise(file_order(base), "files")
    all_ = materialise(cells(base).join(order, ["feed", "file_name"]).select("feed", "no", "line_no", "field", "kind", "h"), "cells")
    kinds = all_.groupBy("feed", "no", "field", "kind").agg(F.count("*").alias("n"))
    fields = kinds.groupBy("feed", "no", "field").agg(F.min(F.when(F.col("kind").isNotNull(), F.struct(-F.col("n"), "kind"))).alias("k"))
    fields = materialise(fields.select("feed", "no", "field", F.col("k.kind").alias("kind")), "fields")
    before = fields.select("feed", (F.col("no") + 1).alias("no"), "field", F.col("kind").alias("was"), F.lit(True).alias("old"))
    here = fields.withColumn("now", F.lit(True))
    # Not beyond the last file; a file without fields still has a number.
    both = here.join(before, ["feed", "no", "field"], "full").join(order.select("feed", "no", "file_name"), ["feed", "no"]).where(F.col("no") > 1)
    changed = both.where(F.col("now").isNull() | F.col("old").isNull() | (F.col("kind") != F.col("was")))
    what = F.when(F.col("now").isNull(), "removed").when(F.col("old").isNull(), "added").otherwise("retyped")
    changed = materialise(changed.select("feed", "no", "file_name", "field", what.alias("what"), F.coalesce("kind", "was").alias("kind")), "changed")
    gone = changed.where("what = 'removed'").select("feed", "no", F.col("field").alias("gone"))
    new = changed.where("what = 'added'").select("feed", "no", F.col("field").alias("new"))
    pairs = gone.join(new, ["feed", "no"])
    # Values that stand in one line of a file and in one of the file before tie the lines: one aggregation by value, to
    # which each cell goes for its own file and for the next.
    cell = all_.where(F.col("h").isNotNull() & F.col("kind").isin("string", "integer"))
    none = F.lit(None).cast("int")
    sides = F.explode(F.array(F.struct("no", F.col("line_no").alias("line"), none.alias("old")), F.struct((F.col("no") + 1).alias("no"), none.alias("line"), F.col("line_no").alias("old"))))
    both_ = cell.select("feed", "h", sides.alias("s")).select("feed", "h", "s.*").groupBy("feed", "no", "h")
    both_ = both_.agg(F.min("line").alias("line"), F.max("line").alias("l2"), F.min("old").alias("old_line"), F.max("old").alias("o2")).where("line = l2 and old_line = o2")
    # A line has no more votes than fields.
    votes = both_.groupBy("feed", "no", "line").agg(F.collect_list("old_line").alias("v"), F.mode("old_line", True).alias("old_line"))
    links = materialise(votes.where(F.size(F.filter("v", lambda x: x == F.col("old_line"))) >= 2).select("feed", "no", "line", "old_line"), "links")
    # The cells of gone and new fields, which are few, are picked out in one pass.
    fates = gone.select("feed", (F.col("no") - 1).alias("no"), F.col("gone").alias("field"), F.lit(True).alias("goes"), F.lit(False).alias("comes"))
    fates = fates.unionByName(new.select("feed", "no", F.col("new").alias("field"), F.lit(False).alias("goes"), F.lit(True).alias("comes")))
    fates = fates.groupBy("feed", "no", "field").agg(F.max("goes").alias("goes"), F.max("comes").alias("comes"))
    moved = materialise(all_.where(F.col("h").isNotNull()).join(broadcast_if_small(fates), ["feed", "no", "field"]).select("feed", "no", "line_no", "field", "h", "goes", "comes"), "moved")
    was = moved.where("goes").select("feed", (F.col("no") + 1).alias("no"), F.col("line_no").alias("old_line"), F.col("field").alias("gone"), F.col("h").alias("old_h"))
    is_ = moved.where("comes").select("feed", "no", F.col("line_no").alias("line"), F.col("field").alias("new"), "h")
    met = links.join(was, ["feed", "no", "old_line"]).join(is_, ["feed", "no", "line"]).groupBy("feed", "no", "gone", "new")
    met = met.agg(F.count("*").alias("both"), F.sum((F.col("h") == F.col("old_h")).cast("int")).alias("equal"))
    # Sketches: the values of least hash of each gone and new field.
    sketch = lambda d, f, h: d.select("feed", "no", f, F.col(h).alias("x")).distinct()
    least = lambda d, f: d.withColumn("r", F.row_number().over(W.partitionBy("feed", "no", f).orderBy("x"))).where(F.col("r") <= SKETCH).drop("r")
    old_s = least(sketch(was, "gone", "old_h"), "gone")
    new_s = least(sketch(is_, "new", "h"), "new")
    common = old_s.join(new_s, ["feed", "no", "x"]).groupBy("feed", "no", "gone", "new").agg(F.count("*").alias("c"))
    size = lambda d, f, n: d.groupBy("feed", "no", f).agg(F.count("*").alias(n))
    graded = pairs.join(met, ["feed", "no", "gone", "new"], "left").join(common, ["feed", "no", "gone", "new"], "left")
    graded = graded.join(size(old_s, "gone", "n1"), ["feed", "no", "gone"], "left").join(size(new_s, "new", "n2"), ["feed", "no", "new"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    graded = graded.join(order.select("feed", "no", "file_name"), ["feed", "no"]).select(
        "feed", "file_name", F.lit("pair").alias("what"), "gone", "new", F.lit(None).cast("string").alias("kind"), zero("both").alias("both"), zero("equal").alias("equal"),
        (zero("c") / F.greatest(F.lit(1), F.least("n1", "n2"))).alias("shared"), (F.col("n1").isNotNull() & F.col("n2").isNotNull()).alias("known"),
    )
    plain = changed.select(
        "feed", "file_name", "what", F.when(F.col("what") == "removed", F.col("field")).alias("gone"), F.when(F.col("what") != "removed", F.col("field")).alias("new"), "kind",
        F.lit(0).cast("bigint").alias("both"), F.lit(0).cast("bigint").alias("equal"), F.lit(0.0).alias("shared"), F.lit(False).alias("known"),
    )
    # A file's fields and their pairs are few, whatever its lines.
    items = F.collect_list(F.struct("what", "gone", "new", "kind", "both", "equal", "shared", "known"))
    return plain.unionByName(graded).groupBy("feed", "file_name").agg(items.alias("items")).mapInArrow(_match, REPORT)


def field_names(names: list[str], renames: list[tuple[str, str, int]]) -> dict[str, str]:
    """What each name is called in the one table: names linked by renames are one field, called after the payload
    field among or most like them; fields like none keep their most used name. Links are taken from the most
    frequent on, and none that would make two payload fields one."""
    home = {n: n for n in names}
    plain = {"".join(_words(p)): p for p in PAYLOAD}
    own = {n: {plain[k]} if (k := "".join(_words(n))) in plain else set() for n in names}

    def root(x: str) -> str:
        while home[x] != x:
            x = home[x]
        return x

    for a, b, _ in sorted(renames, key=lambda r: (-r[2], r[0], r[1])):
        x, y = sorted((root(a), root(b)))
        if x != y and len(own[x] | own[y]) <= 1:
            home[y], own[x] = x, own[x] | own[y]
    # Equal but for case and joints.
    seen: dict[str, str] = {}
    for n in sorted(names):
        x, key = root(n), "".join(_words(n))
        if key in seen and root(seen[key]) != x and len(own[x] | own[root(seen[key])]) <= 1:
            y = root(seen[key])
            home[x], own[y] = y, own[x] | own[y]
        seen.setdefault(key, n)
    return {n: next(iter(own[root(n)]), root(n)) for n in names}


def leaves_of(json: Column) -> Column:
    """The leaves of a JSON list or object as ARRAY<STRING>, decoded, in their order; NULL and blank ones are left out.

    A number or boolean that is a list's own part is a leaf. One under a key is said of the text beside it (its length,
    say), and is a leaf only where there is no other."""
    # Without escaped quotes a string ends at the next quote.
    plain = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    scalar = r"(?:-?[0-9][0-9.eE+-]*+|true|false)"
    tokens = F.regexp_extract_all(plain, F.lit(r'("[^"]*+"(?:\s*+:\s*+' + scalar + "?+)?+|" + scalar + ")"), 1)
    bare = F.filter(tokens, lambda t: ~t.startswith('"') | t.endswith('"'))
    keyed = F.transform(F.filter(tokens, lambda t: t.rlike(r"[0-9e]$")), lambda t: F.regexp_replace(t, r'^"[^"]*+"\s*+:\s*+', ""))
    kept = F.when(F.size(bare) > 0, bare).otherwise(keyed)
    decoded = F.from_json(F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]")), "array<string>")
    return F.filter(decoded, lambda t: F.trim(t) != "")


def unify(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """``(feed, file_name, line_no, *payload fields, extras)``: every object line of all files under the payload's own
    names and types; what isn't a payload field stands in ``extras``.

    ``changes`` is the result of ``schema_changes``. Lists and objects of text become one text of their leaves, parted
    as the field parts them (``SEPARATORS``); a text that only looks like JSON stays as it is. A count is
    a whole number however it is written (25, 25.0, "25" or a list of it), else NULL. Of two names of one field in a line the first by name that has a value
    is taken. Lines that aren't objects are left out; repeated lines stay.
    """
    parsed = lines.select("feed", "file_name", "line_no", "raw", F.try_parse_json(F.col("raw")).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    nested = F.map_keys(F.map_filter(F.col("v").cast("map<string,variant>"), lambda _, x: F.schema_of_variant(x).rlike("^(ARRAY|OBJECT)")))
    named = parsed.select(F.from_json("raw", "map<string,string>").alias("m"), nested.alias("nested"), "feed", "file_name", "line_no").where(F.col("m").isNotNull())
    # Names that may be called otherwise: renamed ones, those that differ from another or from a payload field in case and
    # joints only. All others stay what they are and needn't be known.
    bare = F.lower(F.regexp_replace("n", r"[\W_]+", ""))
    all_names = named.select(F.explode(F.map_keys("m")).alias("n")).distinct().withColumn("key", F.when(bare != "", bare).otherwise(F.col("n")))
    all_names = materialise(all_names, "names")
    links = changes.where("change = 'renamed'").groupBy("former_name", "field_name").agg(F.count("*").alias("n")).collect()
    twins = all_names.groupBy("key").agg(F.count("*").alias("c")).where((F.col("c") > 1) | F.col("key").isin(*["".join(_words(p)) for p in PAYLOAD])).select("key")
    linked = all_names.sparkSession.createDataFrame([(x,) for r in links for x in (r.former_name, r.field_name)], "n string").distinct()
    names = [r.n for r in all_names.join(twins, "key", "left_semi").select("n").union(all_names.join(linked, "n", "left_semi").select("n")).distinct().collect()]
    to = field_names(sorted(names), [(r.former_name, r.field_name, r.n) for r in links if r.former_name in names and r.field_name in names])
    by: dict[str, list[str]] = {}
    for n in sorted(names):
        by.setdefault(to[n], []).append(n)
    value = lambda n: F.try_element_at("m", F.lit(n))
    text = lambda p, n: F.when(F.array_contains("nested", n), F.array_join(leaves_of(value(n)), SEPARATORS.get(p, "；"))).otherwise(value(n))
    first = lambda p, of: F.coalesce(*[F.when(value(n).isNotNull(), of(p, n)) for n in by.get(p, [])], F.lit(None).cast("string"))
    whole = lambda c: F.when(c.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$"), F.regexp_extract(c, r"[+-]?\d+", 0).try_cast("int"))
    out = [whole(first(p, text)).alias(p) if p.endswith("_wafers") else first(p, text).alias(p) for p in PAYLOAD]
    own = F.array(*[F.lit(n) for p in PAYLOAD for n in by.get(p, [])]).cast("array<string>")
    # One literal however many names there are.
    called = F.from_json(F.lit(json.dumps({n: t for n, t in to.items() if n != t}, ensure_ascii=False)), "map<string,string>")
    rest = F.map_filter("m", lambda k, _: ~F.array_contains(own, k))
    # Two names of one extra field: the first by name that stands in the line.
    entries = F.array_sort(F.map_entries(rest))
    pairs = F.transform(entries, lambda e: F.struct(F.coalesce(F.try_element_at(called, e["key"]), e["key"]).alias("k"), e["value"].alias("v")))
    extras = F.map_from_entries(F.filter(pairs, lambda e, i: (i == 0) | ~F.exists(F.slice(pairs, 1, i), lambda x: x["k"] == e["k"])))
    return named.select("feed", "file_name", "line_no", *out, extras.alias("extras"))

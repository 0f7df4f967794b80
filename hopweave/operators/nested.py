"""Deeply nested path records to flat, linked tables (Merkle subtree identities).

Every object of a record (hop, path, record) gets an identity computed bottom-up from its
canonical content: a hop from its fields, a path from its fields and the identities of its
hops in order, a record from its fields and the identities of its paths. Identical objects
are stored once; every occurrence is kept by a bridge row naming parent, place and child.

Identities are 16 bytes of SHA-256. Tables returned by :func:`flatten`:

``records(record_id, origin, record_hash)``: a row for each record
``record_objects(record_hash, question, split, kg)``
``object_paths(record_hash, path_role, path_index, path_hash)``
``paths(path_hash, anchor, anchor_type, answer_type, kg, negative_type, question, extra, n_hops)``
``hops(hop_hash, relation, direction, source_type, target_type, extra)``
``record_paths(record_id, origin, path_role, path_index, path_hash)``: the same links by record
``path_hops(path_hash, hop_index, hop_hash)``

Defined results for odd input: a null or empty list has no bridge rows; a null element keeps
its place (the others keep their index) but has no row; missing fields are null; a line that
is no JSON object holds a record row with null fields and no paths; repeated rows count
once; columns beyond the expected ones are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

_S = T.StringType()
HOP = T.StructType([T.StructField(n, _S) for n in ("relation", "direction", "source_type", "target_type", "extra")])
PATH = T.StructType(
    [
        T.StructField("path_role", _S),
        T.StructField("path_index", T.LongType()),
        *[T.StructField(n, _S) for n in ("anchor", "anchor_type", "answer_type", "kg", "negative_type", "question", "extra")],
        T.StructField("hops", T.ArrayType(HOP)),
    ]
)
NESTED = T.StructType([*[T.StructField(n, _S) for n in ("record_id", "origin", "question", "split", "kg")], T.StructField("paths", T.ArrayType(PATH))])
_PATH_FIELDS = ("anchor", "anchor_type", "answer_type", "kg", "negative_type", "question", "extra")
_ROLES = {"positive_path": "positive", "alternate_positive_paths": "alternate", "negative_paths": "negative"}


@dataclass
class FlatTables:
    """The linked tables. Bridges come from one narrow stage of identities, contents from the nested form."""

    hashed: DataFrame
    bridge: DataFrame

    @property
    def records(self) -> DataFrame:
        return self.bridge.select("record_id", "origin", "record_hash").distinct()

    @property
    def record_objects(self) -> DataFrame:
        one = self.hashed.groupBy("record_hash").agg(F.any_value(F.struct("question", "split", "kg")).alias("r"))
        return one.select("record_hash", "r.*")

    @property
    def object_paths(self) -> DataFrame:
        return self.bridge.select("record_hash", F.explode("paths").alias("p")).select("record_hash", "p.path_role", "p.path_index", "p.path_hash").distinct()

    @property
    def paths(self) -> DataFrame:
        flat = self.hashed.select(F.explode("paths").alias("p"))
        one = flat.groupBy(F.col("p.path_hash").alias("path_hash")).agg(F.any_value(F.struct(*[F.col(f"p.{n}").alias(n) for n in _PATH_FIELDS], F.size("p.hops").cast("long").alias("n_hops"))).alias("p"))
        return one.select("path_hash", "p.*")

    @property
    def hops(self) -> DataFrame:
        flat = self.hashed.select(F.explode(F.flatten(F.transform("paths", lambda p: p["hops"]))).alias("h")).where("h is not null")
        return flat.select("h.hop_hash", *[F.col(f"h.{n}").alias(n) for n in HOP.fieldNames()]).dropDuplicates(["hop_hash"])

    @property
    def record_paths(self) -> DataFrame:
        return self.bridge.select("record_id", "origin", F.explode("paths").alias("p")).select("record_id", "origin", "p.path_role", "p.path_index", "p.path_hash").distinct()

    @property
    def path_hops(self) -> DataFrame:
        one = self.bridge.select(F.explode("paths").alias("p")).groupBy(F.col("p.path_hash").alias("path_hash")).agg(F.max("p.hop_hashes").alias("h"))
        placed = one.select("path_hash", F.posexplode("h").alias("hop_index", "hop_hash")).where("hop_hash is not null")
        return placed.select("path_hash", F.col("hop_index").cast("long").alias("hop_index"), "hop_hash")


def from_examples(examples: DataFrame) -> DataFrame:
    """Typed examples to the common nested form; a column that is lacking counts as null."""
    have = set(examples.columns)

    def col(name: str, kind: str = "string") -> F.Column:
        return (F.col(f"`{name}`").cast(kind) if name in have else F.lit(None).cast(kind)).alias(name)

    def hops(p: F.Column) -> F.Column:
        return F.transform(
            p["hops"],
            lambda h: F.when(
                h.isNotNull(),
                F.struct(*[h[n].alias(n) for n in ("relation", "direction", "source_type", "target_type")], F.lit(None).cast("string").alias("extra")),
            ),
        )

    def path(p: F.Column, role: str, i: F.Column, negative: bool) -> F.Column:
        null = F.lit(None).cast("string")
        return F.when(
            p.isNotNull(),
            F.struct(
                F.lit(role).alias("path_role"),
                i.cast("long").alias("path_index"),
                *[p[n].alias(n) for n in ("anchor", "anchor_type", "answer_type", "kg")],
                (p["negative_type"] if negative else null).alias("negative_type"),
                (p["question"] if negative else null).alias("question"),
                null.alias("extra"),
                hops(p).alias("hops"),
            ),
        )

    parts = []
    if "positive_path" in have:
        parts.append(F.array(path(F.col("positive_path"), "positive", F.lit(0), False)))
    if "alternate_positive_paths" in have:
        parts.append(F.coalesce(F.transform("alternate_positive_paths", lambda p, i: path(p, "alternate", i, False)), F.array().cast(T.ArrayType(PATH))))
    if "negative_paths" in have:
        parts.append(F.coalesce(F.transform("negative_paths", lambda p, i: path(p, "negative", i, True)), F.array().cast(T.ArrayType(PATH))))
    paths = F.filter(F.concat(*parts), lambda p: p.isNotNull()) if parts else F.array().cast(T.ArrayType(PATH))
    return examples.select(col("example_id").alias("record_id"), F.lit("examples").alias("origin"), col("question"), col("split"), col("kg"), paths.alias("paths"))


def _text(x: object) -> str | None:
    """A scalar as text, anything nested as canonical JSON; characters that UTF-8 lacks are replaced."""
    if x is None:
        return None
    s = x if isinstance(x, str) else json.dumps(x, sort_keys=True, ensure_ascii=False)
    return s.encode("utf-8", "replace").decode("utf-8")


def _loads(s: str) -> object:
    def refuse(name: str) -> object:
        raise ValueError(name)

    return json.loads(s, parse_constant=refuse)


def _unwrap(x: object) -> object:
    """A string that holds JSON of an object or list is that object or list."""
    if isinstance(x, str) and x.lstrip()[:1] in ("{", "["):
        try:
            return _loads(x)
        except (ValueError, RecursionError):
            return x
    return x


def _listed(x: object) -> list:
    x = _unwrap(x)
    return [] if x is None else x if isinstance(x, list) else [x]


def _hop(h: object) -> dict | None:
    h = _unwrap(h)
    if h is None:
        return None
    if isinstance(h, dict):
        known = {n: _text(h.get(n)) for n in ("relation", "direction", "source_type", "target_type")}
        rest = {k: v for k, v in h.items() if k not in known}
        return known | {"extra": _text(rest) if rest else None}
    if isinstance(h, (list, tuple)):
        h = {"parts": h}
        return dict.fromkeys(("relation", "direction", "source_type", "target_type")) | {"extra": _text(h)}
    relation, _, direction = (_text(h) or "").partition("::")
    return {"relation": relation, "direction": direction or None, "source_type": None, "target_type": None, "extra": None}


def _path(p: object, role: str, index: int) -> dict | None:
    p = _unwrap(p)
    if p is None:
        return None
    wrapper: dict = {}
    if isinstance(p, dict) and "hops" not in p and "path" in p:
        wrapper, p = {k: v for k, v in p.items() if k != "path"}, _unwrap(p["path"])
        if p is None:
            return None
    if isinstance(p, dict):
        hops, fields = p.get("hops"), wrapper | {k: v for k, v in p.items() if k != "hops"}
    else:  # a bare list (or text) of hops
        hops, fields = p, wrapper
    rest = {k: v for k, v in fields.items() if k not in _PATH_FIELDS}
    return {
        "path_role": role,
        "path_index": index,
        **{n: _text(fields.get(n)) for n in _PATH_FIELDS if n != "extra"},
        "extra": _text(rest) if rest else None,
        "hops": [_hop(h) for h in _listed(hops)],
    }


def parse_line(record_id: str | None, line: str | None) -> dict:
    """One raw line to the nested form; see the module's docstring for odd input."""
    out: dict = {"record_id": record_id, "origin": "raw_examples", "question": None, "split": None, "kg": None, "paths": []}
    try:
        o = _loads(line) if line is not None else None
    except (ValueError, RecursionError):
        return out
    o = _unwrap(o)
    if not isinstance(o, dict):
        return out
    out |= {n: _text(o.get(n)) for n in ("question", "split", "kg")}
    for field, role in _ROLES.items():
        out["paths"] += [q for i, p in enumerate(_path_list(o.get(field))) if (q := _path(p, role, i)) is not None]
    return out


def _path_list(x: object) -> list:
    """The paths under a field; a lone object is a list of one, and so is a bare list of hops in texts."""
    x = _unwrap(x)
    if isinstance(x, list) and x and all(isinstance(y, str) and "::" in y for y in x):
        return [x]
    return _listed(x)


def from_lines(lines: DataFrame, id_col: str = "raw_id", text_col: str = "line_text") -> DataFrame:
    """Raw JSON lines to the common nested form, in Arrow batches."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(NESTED)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(ids), 1000):
                yield pa.RecordBatch.from_pylist([parse_line(i, t) for i, t in zip(ids[lo : lo + 1000], texts[lo : lo + 1000], strict=True)], schema=schema)

    return lines.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(parse, NESTED)


def _identity(*cols: F.Column) -> F.Column:
    """Hash of a tuple; null and the empty text differ, and no value can run into the next."""
    return F.substring(F.unhex(F.sha2(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in cols])), 256)), 1, 16)


def flatten(nested: DataFrame) -> FlatTables:
    """Build the linked tables from the nested form.

    All identities are computed inside the row (no shuffle). Only the identities and places
    are staged, as 16-byte values; the object tables and the distinct bridges shuffle by
    identity after partial aggregation.
    """
    with_hops = F.transform(
        "paths",
        lambda p: p.withField(
            "hops",
            F.transform(
                F.coalesce(p["hops"], F.array().cast(T.ArrayType(HOP))),
                lambda h: F.when(h.isNotNull(), h.withField("hop_hash", _identity(*[h[n] for n in HOP.fieldNames()]))),
            ),
        ),
    )
    hop_list = lambda p: F.concat_ws(",", F.transform(p["hops"], lambda h: F.coalesce(F.hex(h["hop_hash"]), F.lit("-"))))
    with_paths = F.transform("paths", lambda p: p.withField("path_hash", _identity(*[p[n] for n in _PATH_FIELDS], hop_list(p))))
    record_hash = _identity(
        F.col("question"), F.col("split"), F.col("kg"), F.concat_ws(",", F.transform("paths", lambda p: F.concat_ws(":", p["path_role"], p["path_index"].cast("string"), F.hex(p["path_hash"]))))
    )
    hashed = nested.withColumn("paths", with_hops).withColumn("paths", with_paths).withColumn("record_hash", record_hash)
    narrow = F.transform("paths", lambda p: F.struct(p["path_role"].alias("path_role"), p["path_index"].alias("path_index"), p["path_hash"].alias("path_hash"), F.transform(p["hops"], lambda h: h["hop_hash"]).alias("hop_hashes")))
    return FlatTables(hashed, materialize(hashed.select("record_id", "origin", "record_hash", narrow.alias("paths")), "identities"))


def occurrences(t: FlatTables) -> DataFrame:
    """Every hop occurrence: ``record_id, origin, path_role, path_index, hop_index`` plus the identities.

    The join is on the path identity; a path shared by very many records makes one hot key on
    the bridge side only, which adaptive execution splits (the other side has one path's hops).
    A record delivered twice shows twice here; take distinct rows.
    """
    bridge = t.bridge.select("record_id", "origin", F.explode("paths").alias("p")).select("record_id", "origin", "p.path_role", "p.path_index", "p.path_hash")
    return bridge.join(t.path_hops, "path_hash").select("record_id", "origin", "path_role", "path_index", "hop_index", "path_hash", "hop_hash")

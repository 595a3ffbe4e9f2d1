"""Lazy linear operators over keyed vectors, composed with @ + - * / .T .I and lowered to DataFrame plans.

A vector is a DataFrame of key columns and one value column `v` (a tree of arrays has a `leaf` key). Operators are
immutable nodes; `reduce()` applies the algebraic rules that Catalyst cannot know, `apply(df)` lowers the result. Scalars
move to the side of the smaller vector when sizes are known. Every node states its own transpose.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Flag, auto
from functools import reduce as fold

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Tag(Flag):
    NONE = 0
    SQUARE = auto()
    SYMMETRIC = auto()
    ORTHOGONAL = auto()
    DIAGONAL = auto()
    IDEMPOTENT = auto()


class StructureError(ValueError):
    """Vectors or operators whose keys do not fit."""


class Operator:
    tags: Tag = Tag.NONE
    #: Key columns of what goes in and comes out; None: any.
    keys_in: tuple[str, ...] | None = None
    keys_out: tuple[str, ...] | None = None
    size_in: int | None = None
    size_out: int | None = None

    def apply(self, x: DataFrame) -> DataFrame:
        raise NotImplementedError

    def transpose(self) -> Operator:
        if Tag.SYMMETRIC in self.tags:
            return self
        raise NotImplementedError(f"{type(self).__name__} has no transpose")

    def inverse(self) -> Operator:
        if Tag.ORTHOGONAL in self.tags:
            return self.transpose()
        if Tag.SQUARE not in self.tags:
            raise ValueError("only square operators have an inverse")
        return Inverse(self)

    def __call__(self, x: DataFrame) -> DataFrame:
        return self.reduce().apply(x)

    def reduce(self) -> Operator:
        return self

    @property
    def T(self) -> Operator:  # noqa: N802
        return self.transpose()

    @property
    def I(self) -> Operator:  # noqa: N802, E743
        return self.inverse()

    def __matmul__(self, other: Operator) -> Operator:
        if self.keys_in and other.keys_out and set(self.keys_in) != set(other.keys_out):
            raise StructureError(f"{other.keys_out} does not fit {self.keys_in}")
        return Composition((*_parts(self), *_parts(other)))

    def __add__(self, other: Operator) -> Operator:
        if self.keys_in and other.keys_in and set(self.keys_in) != set(other.keys_in):
            raise StructureError(f"{self.keys_in} does not fit {other.keys_in}")
        terms = [t for o in (self, other) for t in (o.terms if isinstance(o, Addition) else (o,))]
        return Addition(tuple(terms))

    def __mul__(self, k: float) -> Operator:
        if not isinstance(k, (int, float)):
            raise TypeError("only scalars multiply operators; use @ to compose")
        return Homothety(float(k)) @ self

    __rmul__ = __mul__

    def __truediv__(self, k: float) -> Operator:
        return self * (1 / k)

    def __neg__(self) -> Operator:
        return self * -1.0

    def __pos__(self) -> Operator:
        return self

    def __sub__(self, other: Operator) -> Operator:
        return self + (-other)


def _parts(op: Operator) -> tuple[Operator, ...]:
    return op.parts if isinstance(op, Composition) else (op,)


@dataclass(frozen=True, eq=False)
class Identity(Operator):
    tags = Tag.SQUARE | Tag.SYMMETRIC | Tag.ORTHOGONAL | Tag.DIAGONAL | Tag.IDEMPOTENT

    def apply(self, x):
        return x

    def inverse(self):
        return self


@dataclass(frozen=True, eq=False)
class Homothety(Operator):
    k: float
    tags = Tag.SQUARE | Tag.SYMMETRIC | Tag.DIAGONAL

    def apply(self, x):
        return x.withColumn("v", F.col("v") * self.k)

    def inverse(self):
        return Homothety(1 / self.k)


@dataclass(frozen=True, eq=False)
class Diagonal(Operator):
    """d(on, d) times the vector, joined on the named axes."""

    d: DataFrame
    on: tuple[str, ...]
    tags = Tag.SQUARE | Tag.SYMMETRIC | Tag.DIAGONAL

    def apply(self, x):
        return x.join(self.d, list(self.on)).withColumn("v", F.col("v") * F.col("d")).drop("d")

    def inverse(self):
        return Diagonal(self.d.withColumn("d", F.when(F.col("d") != 0, 1 / F.col("d")).otherwise(0.0)), self.on)


@dataclass(frozen=True, eq=False)
class Mask(Operator):
    """Zero where the condition (SQL over the vector's columns) does not hold; rows stay."""

    condition: str
    tags = Tag.SQUARE | Tag.SYMMETRIC | Tag.DIAGONAL | Tag.IDEMPOTENT

    def apply(self, x):
        return x.withColumn("v", F.when(F.expr(self.condition), F.col("v")).otherwise(0.0))

    def complement(self) -> Mask:
        return Mask(f"NOT coalesce(({self.condition}), false)")

    def restrict(self, condition: str) -> Mask:
        return Mask(f"({self.condition}) AND ({condition})")


@dataclass(frozen=True, eq=False)
class Pack(Operator):
    """Rows where the condition holds. `axis`: the full key range, to which the transpose gives back zeros."""

    condition: str
    axis: DataFrame | None = None

    def apply(self, x):
        return x.where(self.condition)

    def transpose(self):
        return Unpack(self)


@dataclass(frozen=True, eq=False)
class Unpack(Operator):
    pack: Pack

    def apply(self, x):
        axis = self.pack.axis
        return axis.join(x, axis.columns, "left").withColumn("v", F.coalesce("v", F.lit(0.0)))

    def transpose(self):
        return self.pack


@dataclass(frozen=True, eq=False)
class Gather(Operator):
    """y[out] = x[key] for a table (out..., key); duplicates allowed. The transpose adds up by key."""

    table: DataFrame
    out: tuple[str, ...]
    key: str = "pix"
    unique: bool = False

    def apply(self, x):
        return self.table.join(x, self.key).select(*self.out, "v")

    def transpose(self):
        return Scatter(self)


@dataclass(frozen=True, eq=False)
class Scatter(Operator):
    gather: Gather

    def apply(self, x):
        g = self.gather
        return g.table.join(x, list(g.out)).groupBy(g.key).agg(F.sum("v").alias("v"))

    def transpose(self):
        return self.gather


@dataclass(frozen=True, eq=False)
class Coverage(Operator):
    """Scatter after gather: a diagonal of counts, without the join of the samples."""

    gather: Gather
    tags = Tag.SQUARE | Tag.SYMMETRIC | Tag.DIAGONAL

    def apply(self, x):
        hits = self.gather.table.groupBy(self.gather.key).agg(F.count("*").alias("hits"))
        return hits.join(x, self.gather.key).select(self.gather.key, (F.col("hits") * F.col("v")).alias("v"))


@dataclass(frozen=True, eq=False)
class Sum(Operator):
    """Sum over every key but those kept; () sums all."""

    keep: tuple[str, ...]

    def apply(self, x):
        return x.groupBy(*self.keep).agg(F.sum("v").alias("v"))


@dataclass(frozen=True, eq=False)
class Matrix(Operator):
    """A sparse or dense matrix (row, col, val), batched over further shared key columns."""

    table: DataFrame
    row: str = "row"
    col: str = "col"
    batch: tuple[str, ...] = ()
    tags: Tag = field(default=Tag.NONE)

    def apply(self, x):
        a = self.table.select(*self.batch, F.col(self.row).alias("__row"), F.col(self.col).alias(self.col), "val")
        return a.join(x, [*self.batch, self.col]).groupBy(*self.batch, F.col("__row").alias(self.row)).agg(F.sum(F.col("val") * F.col("v")).alias("v"))

    def transpose(self):
        return Matrix(self.table, self.col, self.row, self.batch, self.tags)


@dataclass(frozen=True, eq=False)
class Toeplitz(Operator):
    """Symmetric band Toeplitz along `axis` within `by`; zero beyond the ends. Narrow bands: one window, no self join."""

    bands: tuple[float, ...]
    axis: str = "samp"
    by: tuple[str, ...] = ("det",)
    tags = Tag.SQUARE | Tag.SYMMETRIC

    def apply(self, x):
        w = Window.partitionBy(*self.by).orderBy(self.axis)
        out = F.col("v") * self.bands[0]
        for k, b in enumerate(self.bands[1:], 1):
            out = out + (F.coalesce(F.lag("v", k).over(w), F.lit(0.0)) + F.coalesce(F.lead("v", k).over(w), F.lit(0.0))) * b
        return x.withColumn("v", out)


@dataclass(frozen=True, eq=False)
class IntervalProjection(Operator):
    """Minus the mean of each full run of tau samples; the tail stays."""

    tau: int
    axis: str = "samp"
    by: tuple[str, ...] = ("det",)
    tags = Tag.SQUARE | Tag.SYMMETRIC | Tag.IDEMPOTENT

    def apply(self, x):
        k = F.floor(F.col(self.axis) / self.tau)
        y = x.withColumn("__k", k)
        w = Window.partitionBy(*self.by, "__k")
        return y.withColumn("v", F.when(F.count("*").over(w) == self.tau, F.col("v") - F.avg("v").over(w)).otherwise(F.col("v"))).drop("__k")


@dataclass(frozen=True, eq=False)
class Rotation(Operator):
    """(q, u) of a Stokes table turned by an angle (SQL over its columns)."""

    angle: str
    atomic: bool = False
    tags = Tag.SQUARE | Tag.ORTHOGONAL

    def apply(self, x):
        a = F.expr(self.angle) * 2
        return x.withColumns({"q": F.col("q") * F.cos(a) + F.col("u") * F.sin(a), "u": F.col("u") * F.cos(a) - F.col("q") * F.sin(a)})

    def transpose(self):
        return Rotation(f"-({self.angle})", self.atomic)


@dataclass(frozen=True, eq=False)
class HalfWavePlate(Operator):
    tags = Tag.SQUARE | Tag.SYMMETRIC | Tag.ORTHOGONAL | Tag.DIAGONAL

    def apply(self, x):
        return x.withColumns({c: -F.col(c) for c in ("u", "v") if c in x.columns})


@dataclass(frozen=True, eq=False)
class Polarizer(Operator):
    def apply(self, x):
        return x.withColumn("d", (F.col("i") + F.col("q")) * 0.5).drop("i", "q", "u", "v")

    def transpose(self):
        return PolarizerTranspose()


@dataclass(frozen=True, eq=False)
class PolarizerTranspose(Operator):
    def apply(self, x):
        return x.withColumns({"i": F.col("d") * 0.5, "q": F.col("d") * 0.5, "u": F.lit(0.0)}).drop("d")

    def transpose(self):
        return Polarizer()


@dataclass(frozen=True, eq=False)
class Function(Operator):
    """A user's linear function on DataFrames; the transpose is the user's too."""

    func: object
    adjoint: object = None

    def apply(self, x):
        return self.func(x)

    def transpose(self):
        if self.adjoint is None:
            raise NotImplementedError("this function was wrapped without its transpose")
        return Function(self.adjoint, self.func)


@dataclass(frozen=True, eq=False)
class Inverse(Operator):
    """A x = b solved by conjugate gradients over distributed steps; see solvers.solve."""

    op: Operator
    tags = Tag.SQUARE

    def apply(self, x):
        from tessera.operators.solvers import solve

        return solve(self.op.reduce(), x)

    def transpose(self):
        return Inverse(self.op.T)

    def inverse(self):
        return self.op


# --- blocks over the leaves of a tree ------------------------------------------------------------------------------

@dataclass(frozen=True, eq=False)
class BlockDiagonal(Operator):
    blocks: dict[str, Operator]

    def apply(self, x):
        return fold(DataFrame.unionByName, [op(x.where(F.col("leaf") == k).drop("leaf")).withColumn("leaf", F.lit(k)) for k, op in self.blocks.items()])

    def transpose(self):
        return BlockDiagonal({k: op.T for k, op in self.blocks.items()})

    def inverse(self):
        return BlockDiagonal({k: op.I for k, op in self.blocks.items()})

    def reduce(self):
        blocks = {k: op.reduce() for k, op in self.blocks.items()}
        return Identity() if all(isinstance(op, Identity) for op in blocks.values()) else BlockDiagonal(blocks)


@dataclass(frozen=True, eq=False)
class BlockRow(Operator):
    """Sum of the blocks, each on its leaf."""

    blocks: dict[str, Operator]

    def apply(self, x):
        parts = [op(x.where(F.col("leaf") == k).drop("leaf")) for k, op in self.blocks.items()]
        keys = [c for c in parts[0].columns if c != "v"]
        return fold(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("v").alias("v"))

    def transpose(self):
        return BlockColumn({k: op.T for k, op in self.blocks.items()})


@dataclass(frozen=True, eq=False)
class BlockColumn(Operator):
    """The same vector through every block, one leaf each."""

    blocks: dict[str, Operator]

    def apply(self, x):
        return fold(DataFrame.unionByName, [op(x).withColumn("leaf", F.lit(k)) for k, op in self.blocks.items()])

    def transpose(self):
        return BlockRow({k: op.T for k, op in self.blocks.items()})


# --- composition, addition and their rules -------------------------------------------------------------------------

@dataclass(frozen=True, eq=False)
class Composition(Operator):
    parts: tuple[Operator, ...]

    @property
    def tags(self):
        return Tag.SQUARE if all(Tag.SQUARE in p.tags for p in self.parts) else Tag.NONE

    def apply(self, x):
        for op in reversed(self.parts):
            x = op.apply(x)
        return x

    def transpose(self):
        return Composition(tuple(p.T for p in reversed(self.parts)))

    def inverse(self):
        return Composition(tuple(p.I for p in reversed(self.parts)))

    def reduce(self):
        parts, scale = [], 1.0
        for op in (p for o in self.parts for p in _parts(o.reduce())):
            if isinstance(op, Homothety):
                scale *= op.k
            elif not isinstance(op, Identity):
                parts.append(op)
        at = 0
        while at < len(parts) - 1:
            new = next((out for rule in PAIR_RULES if (out := rule(parts[at], parts[at + 1])) is not None), None)
            if new is None:
                at += 1
                continue
            parts[at : at + 2] = [p for p in new if not isinstance(p, Identity)]
            at = max(0, at - 1)
        if scale != 1.0:
            left = not parts or (parts[0].size_out or 0) <= (parts[-1].size_in or 0) or isinstance(parts[0], (Scatter, Sum, BlockRow, Coverage))
            parts.insert(0 if left else len(parts), Homothety(scale))
        return Identity() if not parts else parts[0] if len(parts) == 1 else Composition(tuple(parts))


@dataclass(frozen=True, eq=False)
class Addition(Operator):
    terms: tuple[Operator, ...]

    @property
    def tags(self):
        return Tag.SQUARE if all(Tag.SQUARE in t.tags for t in self.terms) else Tag.NONE

    def apply(self, x):
        parts = [t.apply(x) for t in self.terms]
        keys = [c for c in parts[0].columns if c != "v"]
        return fold(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("v").alias("v"))

    def transpose(self):
        return Addition(tuple(t.T for t in self.terms))

    def reduce(self):
        scale, rest = 0.0, []
        for t in (t.reduce() for t in self.terms):
            if isinstance(t, (Homothety, Identity)):
                scale += t.k if isinstance(t, Homothety) else 1.0
            else:
                rest.append(t)
        terms = ([Homothety(scale)] if scale else []) + rest
        if not terms:
            return Homothety(0.0)
        return terms[0] if len(terms) == 1 else Addition(tuple(terms))


def _inverse_pair(a, b):
    if isinstance(a, Inverse) and a.op is b or isinstance(b, Inverse) and b.op is a:
        return [Identity()]
    return None


def _idempotent(a, b):
    return [a] if a is b and Tag.IDEMPOTENT in a.tags else None


def _masks(a, b):
    return [Mask(f"({a.condition}) AND ({b.condition})")] if isinstance(a, Mask) and isinstance(b, Mask) else None


def _pack_unpack(a, b):
    return [Identity()] if isinstance(a, Pack) and isinstance(b, Unpack) and b.pack is a else None


def _gather_scatter(a, b):
    if isinstance(a, Gather) and isinstance(b, Scatter) and b.gather is a and a.unique:
        return [Identity()]
    return [Coverage(b)] if isinstance(a, Scatter) and isinstance(b, Gather) and a.gather is b else None


def _blocks(a, b):
    if isinstance(a, BlockDiagonal) and isinstance(b, (BlockDiagonal, BlockColumn)):
        return [type(b)({k: (a.blocks[k] @ b.blocks[k]).reduce() for k in b.blocks})]
    if isinstance(a, BlockRow) and isinstance(b, BlockDiagonal):
        return [BlockRow({k: (a.blocks[k] @ b.blocks[k]).reduce() for k in b.blocks})]
    if isinstance(a, BlockRow) and isinstance(b, BlockColumn):
        return [Addition(tuple(a.blocks[k] @ b.blocks[k] for k in b.blocks)).reduce()]
    return None


def _rotations(a, b):
    if isinstance(a, Rotation) and isinstance(b, Rotation) and not (a.atomic or b.atomic):
        return [Identity()] if a.angle == f"-({b.angle})" or b.angle == f"-({a.angle})" else [Rotation(f"({a.angle}) + ({b.angle})")]
    if isinstance(a, Rotation) and isinstance(b, HalfWavePlate):
        return [b, a.T]
    if isinstance(a, HalfWavePlate) and isinstance(b, HalfWavePlate):
        return [Identity()]
    return [a] if isinstance(a, Polarizer) and isinstance(b, HalfWavePlate) else None


#: In order of priority.
PAIR_RULES = [_inverse_pair, _idempotent, _masks, _pack_unpack, _gather_scatter, _blocks, _rotations]

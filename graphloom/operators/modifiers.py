"""Binding modifiers: computed variables and tests over bindings, with a usage chosen when the plan is built.

A modifier names its variables result first (``sum a b c`` is a = b + c). If all are bound it is a test; otherwise
it binds the missing ones by the usage that fits. Values of the wrong kind drop their row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from .columns import computed

NUMBER = "decimal(38,0)"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def negative(x: Column) -> Column:
    """-x to the last digit; Spark's own minus and abs round decimals to 34 digits."""
    return F.try_subtract(F.lit(0).cast(NUMBER), x).try_cast(NUMBER)


def absolute(x: Column) -> Column:
    return F.when(x < 0, negative(x)).otherwise(x)


def _multiple(a: Column, b: Column) -> Column:
    """floor(a / b) for b > 0 and quotients of up to 31 digits; Spark's own quotient has six decimals and truncates."""
    return (F.try_subtract(a, F.pmod(a, b)) / b).try_cast(NUMBER)


def _quotient(a: Column, size: Column) -> Column:
    """floor(a / size) for size > 0: at once where it is short, else in two parts."""
    part = F.lit(f"1{0:019d}").cast(NUMBER)

    def parts(high: Column) -> Column:
        low = F.try_add(F.try_multiply(F.pmod(high, size), part).try_cast(NUMBER), F.pmod(a, part)).try_cast(NUMBER)
        return _let(low, lambda x: F.try_add(F.try_multiply(_multiple(high, size), part).try_cast(NUMBER), _multiple(x, size)).try_cast(NUMBER))

    return F.when(size < F.lit(f"1{0:018d}").cast(NUMBER), _let(_multiple(a, part), parts)).otherwise(_multiple(a, size))


def div_floor(a: Column, b: Column) -> Column:
    """Floor division of whole numbers of 38 digits; NULL for a zero divisor."""

    def floor(x: Column, y: Column) -> Column:
        size = absolute(F.when(y != 0, y)).cast(NUMBER)
        signed = lambda q: F.when(y > 0, q).when(F.pmod(x, size) == 0, negative(q)).otherwise(F.try_subtract(negative(q), F.lit(1))).try_cast(NUMBER)
        return _let(size, lambda n: _let(_quotient(x, n), signed))

    return _let(F.struct(a.cast(NUMBER).alias("a"), b.cast(NUMBER).alias("b")), lambda t: floor(t["a"], t["b"]))


def mod_floor(a: Column, b: Column) -> Column:
    rest = F.pmod(a, absolute(F.when(b != 0, b)))
    return F.when((b < 0) & (rest != 0), rest + b).otherwise(rest).try_cast(NUMBER)


def exact_quotient(a: Column, b: Column) -> Column:
    return F.when((b != 0) & (mod_floor(a, b) == 0), div_floor(a, b))


def power(a: Column, e: Column) -> Column:
    """Exact power for exponents of 0 and more; NULL beyond 38 digits and for negative exponents."""
    steps = F.sequence(F.lit(1), F.greatest(F.least(e, F.lit(130)), F.lit(1)).cast("int"))
    value = F.aggregate(steps, F.lit(1).cast(NUMBER), lambda acc, _: F.try_multiply(acc, a).try_cast(NUMBER))
    return F.when(e == 0, F.lit(1).cast(NUMBER)).when(((a == 0) | (a == 1)) & (e > 0), a).when((a == -1) & (e > 0), F.when(mod_floor(e, F.lit(2).cast(NUMBER)) == 0, F.lit(1)).otherwise(F.lit(-1)).cast(NUMBER)).when((e > 0) & (e <= 130), value)


@dataclass(frozen=True)
class Usage:
    """Positions it binds, from all others, each by an expression of the values."""

    binds: dict[int, Callable[..., Column]]


@dataclass(frozen=True)
class Modifier:
    """A test of all values, and usages in order of preference; ``values`` and ``back`` convert terms."""

    name: str
    size: int
    test: Callable[..., Column]
    usages: tuple[Usage, ...] = ()
    values: Callable[[str], Column] = T.as_integer
    back: Callable[[Column], Column] = T.integer

    def usage_for(self, bound: set[int]) -> Usage | None:
        """The usage that binds just what is missing; None if the modifier can only test or can't be used."""
        missing = set(range(self.size)) - bound
        return next((u for u in self.usages if set(u.binds) == missing), None)

    def holds(self, *variables: str) -> Column:
        """All variables have values of the right kind, and these pass the test; never null."""
        value = [self.values(v) for v in variables]
        present = reduce(lambda a, b: a & b, (v.isNotNull() for v in value))
        return present & F.coalesce(self.test(*value), F.lit(False))

    def apply(self, bindings: DataFrame, *variables: str) -> DataFrame:
        if len(variables) != self.size:
            raise ValueError(f"{self.name} takes {self.size} variables")
        bound = {i for i, v in enumerate(variables) if v in bindings.columns}
        usage = None if len(bound) == self.size else self.usage_for(bound)
        if usage is None and len(bound) < self.size:
            raise ValueError(f"{self.name} has no usage for bound variables {[variables[i] for i in sorted(bound)]}")
        # values in columns of their own, or each use of them would parse their terms again
        given, own = bindings.columns, {i: f"_value{i}" for i in sorted(bound)}
        rows = computed(bindings, {own[i]: self.values(variables[i]) for i in own}) if own else bindings
        rows = rows.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in own.values()), F.lit(True)))
        value = [F.col(own[i]) if i in own else None for i in range(self.size)]
        if usage is None:
            return rows.where(F.coalesce(self.test(*value), F.lit(False))).select(*given)
        new = {variables[i]: self.back(f(*value)) for i, f in usage.binds.items()}
        return computed(rows, new).select(*given, *new).where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in new)))


def _n(c: Column) -> Column:
    return c.try_cast(NUMBER)


INTEGER = {
    m.name: m
    for m in (
        Modifier("abs", 2, lambda a, b: a == absolute(b), (Usage({0: lambda a, b: absolute(b)}),)),
        Modifier("neg", 2, lambda a, b: a == negative(b), (Usage({0: lambda a, b: negative(b)}), Usage({1: lambda a, b: negative(a)}))),
        Modifier("sum", 3, lambda a, b, c: a == F.try_add(b, c), (Usage({0: lambda a, b, c: _n(F.try_add(b, c))}), Usage({1: lambda a, b, c: _n(F.try_subtract(a, c))}), Usage({2: lambda a, b, c: _n(F.try_subtract(a, b))}))),
        Modifier("diff", 3, lambda a, b, c: a == F.try_subtract(b, c), (Usage({0: lambda a, b, c: _n(F.try_subtract(b, c))}), Usage({1: lambda a, b, c: _n(F.try_add(a, c))}), Usage({2: lambda a, b, c: _n(F.try_subtract(b, a))}))),
        Modifier("prod", 3, lambda a, b, c: a == F.try_multiply(b, c), (Usage({0: lambda a, b, c: _n(F.try_multiply(b, c))}), Usage({1: lambda a, b, c: exact_quotient(a, c)}), Usage({2: lambda a, b, c: exact_quotient(a, b)}))),
        Modifier("divmod", 4, lambda q, r, n, d: (q == div_floor(n, d)) & (r == mod_floor(n, d)), (Usage({0: lambda q, r, n, d: div_floor(n, d), 1: lambda q, r, n, d: mod_floor(n, d)}),)),
        Modifier("power", 3, lambda a, b, c: a == power(b, c), (Usage({0: lambda a, b, c: power(b, c)}),)),
        Modifier("eq", 2, lambda a, b: a == b),
        Modifier("ne", 2, lambda a, b: a != b),
        Modifier("lt", 2, lambda a, b: a < b),
        Modifier("le", 2, lambda a, b: a <= b),
        Modifier("gt", 2, lambda a, b: a > b),
        Modifier("ge", 2, lambda a, b: a >= b),
    )
}


def text_value(v: str) -> Column:
    from ..functions.vocab import STRING as XSD_STRING

    return F.when(T.datatype(v) == XSD_STRING, T.lexical(v))


STRING = {
    "eq": Modifier("eq", 2, lambda a, b: a == b, (), text_value),
    "ne": Modifier("ne", 2, lambda a, b: a != b, (), text_value),
}


def total(bindings: DataFrame, result: str, *variables: str) -> DataFrame:
    """Sum of any number of integer variables, bound to ``result`` or compared with it."""
    value = reduce(lambda a, b: _n(F.try_add(a, b)), map(T.as_integer, variables))
    if result in bindings.columns:
        return bindings.where(F.coalesce(T.as_integer(result) == value, F.lit(False)))
    return bindings.withColumn(result, T.integer(value)).where(F.col(result).isNotNull())


@dataclass(frozen=True)
class Step:
    """A modifier applied to its variables."""

    modifier: Modifier
    variables: tuple[str, ...]

    def __call__(self, bindings: DataFrame) -> DataFrame:
        return self.modifier.apply(bindings, *self.variables)


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One after the other; a step whose variables are bound by then is a test. No steps change nothing."""
    return lambda bindings: reduce(lambda b, f: f(b), steps, bindings)


def find_order(bound: set[str], steps: list[Step]) -> list[Step] | None:
    """An order in which every step can be used, or None."""
    if not steps:
        return []
    for s in steps:
        have = {i for i, v in enumerate(s.variables) if v in bound}
        if len(have) == s.modifier.size or s.modifier.usage_for(have):
            rest = find_order(bound | set(s.variables), [x for x in steps if x is not s])
            if rest is not None:
                return [s, *rest]
    return None

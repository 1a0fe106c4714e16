"""Key encodings and scalar functions, as Spark column expressions.

Keys are unsigned 64-bit. Non-negative keys are BIGINT; the full domain is
DECIMAL(20,0), or BIGINT bits ordered by `ordered_bits`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_MIN, KEY_MAX = 0, 2**64 - 1
#: The 64-bit FNV offset basis and prime.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 1099511628211

_WIDE = "decimal(38,0)"


def wide(x: Column | int) -> Column:
    """A number that can hold any key and products of a key with a small number."""
    return F.lit(str(x)).cast(_WIDE) if isinstance(x, int) else x.cast(_WIDE)


def unsigned(bits: Column) -> Column:
    """DECIMAL(20,0) value of a BIGINT's bits read as unsigned."""
    return F.when(bits < 0, bits.cast("decimal(20,0)") + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(bits.cast("decimal(20,0)")).cast("decimal(20,0)")


def signed(key: Column) -> Column:
    """BIGINT with the bits of an unsigned key."""
    wide_ = key.cast("decimal(20,0)")
    return F.when(wide_ >= F.lit(str(2**63)).cast("decimal(20,0)"), wide_ - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(wide_).cast("long")


def ordered_bits(bits: Column) -> Column:
    """A BIGINT whose signed order is the unsigned order of the bits."""
    return bits.bitwiseXOR(F.lit(-(2**63)))


def from_ordered_bits(x: Column) -> Column:
    return x.bitwiseXOR(F.lit(-(2**63)))


def _low_times(h: Column, bits: int) -> Column:
    """h * FNV_PRIME modulo 2^64 for unsigned h as two 32-bit halves: struct(hi, lo). ANSI-safe."""
    p_hi, p_lo = FNV_PRIME >> 32, FNV_PRIME & 0xFFFFFFFF
    # lo * p_lo needs 16-bit steps: p_lo is below 2^9, so lo * p_lo fits in 2^41.
    low = h["lo"] * F.lit(p_lo)
    high = h["hi"] * F.lit(p_lo) + h["lo"] * F.lit(p_hi) + F.shiftright(low, 32)
    mask = F.lit(0xFFFFFFFF)
    return F.struct(high.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))


def _fnv_halves(x: Column) -> Column:
    def step(h: Column, i: Column) -> Column:
        octet = F.call_function("shiftrightunsigned", x.cast("long"), i * 8).bitwiseAND(F.lit(255))
        return _low_times(F.struct(h["hi"].alias("hi"), h["lo"].bitwiseXOR(octet).alias("lo")), 64)

    start = F.struct(F.lit(FNV_BASIS >> 32).cast("long").alias("hi"), F.lit(FNV_BASIS & 0xFFFFFFFF).cast("long").alias("lo"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), start, step)


def fnv_hash(x: Column) -> Column:
    """Unsigned 64-bit FNV-1a over the eight octets of a BIGINT, lowest first, as DECIMAL(20,0)."""
    halves = F.transform(F.array(_fnv_halves(x)), lambda h: h["hi"].cast("decimal(20,0)") * F.lit(str(2**32)).cast("decimal(20,0)") + h["lo"].cast("decimal(20,0)"))
    return F.when(x.isNotNull(), F.element_at(halves, 1).cast("decimal(20,0)"))


def scramble(x: Column, base: int, n: int) -> Column:
    """base + fnv_hash(x) modulo n."""
    return (F.lit(base) + (fnv_hash(x) % F.lit(n)).cast("long")).cast("long")


def task_word(task: Column, operand: Column) -> Column:
    """A task id in the low 32 bits and an operand in the high 32."""
    return F.shiftleft(operand.cast("long"), 32).bitwiseOR(task.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def task_id(word: Column) -> Column:
    return word.bitwiseAND(F.lit(0xFFFFFFFF))


def task_operand(word: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, F.lit(32))


def equi_width_ub(nth: Column, n: int, key_max: int = KEY_MAX) -> Column:
    """Inclusive upper bound of the nth of n equal key ranges, nth from 1; the last is key_max."""
    q, r = divmod(key_max, n)
    i = wide(nth)
    return (wide(q) * i + ((wide(r) * i) - (wide(r) * i) % wide(n)) / wide(n)).cast("decimal(20,0)")


def align_up(x: Column, step: int) -> Column:
    """The smallest multiple of step that isn't below x."""
    x = wide(x)
    rest = x % wide(step)
    return (x + F.when(rest == 0, wide(0)).otherwise(wide(step) - rest)).cast("decimal(20,0)")


def str_to_bool(s: Column) -> Column:
    """true/1 and false/0 in any case; anything else is an error, null stays null."""
    low = F.lower(s)
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False).when(s.isNull(), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), s)).cast("boolean"))


def trim_ws(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(s, r"^\s+", ""), r"\s+$", "")


def printable(u: Column) -> Column:
    """The printable character that a number in [0, 1) stands for: '!' to '~'."""
    return F.chr(F.floor(u * 94).cast("int") + 33)


def unit(x: Column, seed: int = 0) -> Column:
    """A reproducible number in (0, 1) from a BIGINT: the upper 52 bits of its hash under the seed, in the middle of their step."""
    top = F.transform(F.array(_fnv_halves(x.cast("long").bitwiseXOR(F.lit(seed_bits(seed))))), lambda h: F.shiftleft(h["hi"], 20) + F.shiftright(h["lo"], 12))
    return (F.element_at(top, 1).cast("double") + 0.5) / F.lit(float(1 << 52))


def seed_bits(seed: int) -> int:
    """What a seed adds to the numbers that are hashed: bits above those of any count of rows."""
    return (seed * 0x9E3779B1 & 0x7FFF) << 48


def parse_cell(s: Column, rows: int, cols: int) -> Column:
    """struct(row, col) of "r" or "r,c": -1 or nothing means all, others are held inside the grid."""
    part = F.split(s, ",")

    def one(i: int, most: int) -> Column:
        v = F.try_to_number(F.trim(F.get(part, F.lit(i))), F.lit("S9999999999")).cast("int")
        return F.when(v.isNull() | (v < 0), F.lit(-1)).otherwise(F.least(v, F.lit(most - 1)))

    return F.struct(one(0, rows).alias("row"), one(1, cols).alias("col"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)

"""Feature engineering as lists of column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import arrays
from granary.functions.scalars import col, cyclic, hour_of, log1p_clipped, null_safe_sum, safe_ratio
from granary.operators.profile import skewed_columns
from granary.operators.quantiles import quantile_values


@dataclass(frozen=True)
class Derived:
    """A new column made only if the columns it needs exist."""

    name: str
    needs: tuple[str, ...]
    make: Callable[[DataFrame], Column]


def derive(df: DataFrame, features: Sequence[Derived]) -> DataFrame:
    """Adds the features whose inputs exist; features may use earlier ones."""
    for f in features:
        if all(n in df.columns for n in f.needs):
            df = df.withColumn(f.name, f.make(df))
    return df


def _d(name: str, needs: str, make: Callable[[], Column]) -> Derived:
    return Derived(name, tuple(needs.split()), lambda df: make())


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def house_features() -> list[Derived]:
    """Age, area, bathroom, quality, garage, presence and season features of a house sale."""
    zero = lambda c: F.coalesce(_q(c), F.lit(0))
    # fixed values: column names of the house-sales table
    porches = ["Open.Porch.SF", "Enclosed.Porch", "X3Ssn.Porch", "Screen.Porch"]
    baths = {"Full.Bath": 1.0, "Bsmt.Full.Bath": 1.0, "Half.Bath": 0.5, "Bsmt.Half.Bath": 0.5}
    present = {
        "Has_Pool": "Pool.Area",
        "Has_Fireplace": "Fireplaces",
        "Has_2nd_Floor": "X2nd.Flr.SF",
        "Has_Basement": "Total.Bsmt.SF",
    }
    seasons = {"Spring": (3, 4, 5), "Summer": (6, 7, 8), "Fall": (9, 10, 11), "Winter": (12, 1, 2)}

    def porch_sum(df):
        return null_safe_sum(*[_q(p) for p in porches if p in df.columns])

    def bath_sum(df):
        return null_safe_sum(*[_q(b) * w for b, w in baths.items() if b in df.columns])

    out = [
        _d("House_Age", "Yr.Sold Year.Built", lambda: F.greatest(F.lit(0), _q("Yr.Sold") - _q("Year.Built"))),
        _d(
            "Years_Since_Remodel",
            "Yr.Sold Year.Remod.Add",
            lambda: F.greatest(F.lit(0), _q("Yr.Sold") - _q("Year.Remod.Add")),
        ),
        _d("Was_Remodeled", "Year.Remod.Add Year.Built", lambda: _flag(_q("Year.Remod.Add") != _q("Year.Built"))),
        _d("Is_New", "Yr.Sold Year.Built", lambda: _flag(_q("Yr.Sold") == _q("Year.Built"))),
        _d("Total_SF", "area Total.Bsmt.SF", lambda: F.col("area") + zero("Total.Bsmt.SF")),
        Derived("Total_Porch_SF", (porches[0],), porch_sum),
        _d("Total_Outdoor_SF", "Total_Porch_SF Wood.Deck.SF", lambda: F.col("Total_Porch_SF") + zero("Wood.Deck.SF")),
        _d(
            "Bsmt_Finished_Ratio",
            "Total.Bsmt.SF Bsmt.Unf.SF",
            lambda: safe_ratio(zero("Total.Bsmt.SF") - zero("Bsmt.Unf.SF"), zero("Total.Bsmt.SF")),
        ),
        _d("Above_Grade_Ratio", "area Total_SF", lambda: safe_ratio("area", "Total_SF", 1.0)),
        Derived("Total_Bathrooms", ("Full.Bath",), bath_sum),
        _d("Qual_Cond_Product", "Overall.Qual Overall.Cond", lambda: _q("Overall.Qual") * _q("Overall.Cond")),
        _d("Qual_Cond_Sum", "Overall.Qual Overall.Cond", lambda: _q("Overall.Qual") + _q("Overall.Cond")),
        _d("Qual_Per_SF", "Overall.Qual area", lambda: F.try_divide(_q("Overall.Qual"), F.col("area") / 1000)),
        _d("Has_Garage", "Garage.Cars", lambda: _flag(_q("Garage.Cars") > 0)),
        _d(
            "Garage_Area_Per_Car",
            "Garage.Area Garage.Cars",
            lambda: safe_ratio(zero("Garage.Area"), zero("Garage.Cars")),
        ),
    ]
    for name, source in present.items():
        out.append(Derived(name, (source,), lambda df, s=source: _flag(_q(s) > 0)))
    out.append(_d("Has_Central_Air", "Central.Air", lambda: _flag(_q("Central.Air") == "Y")))
    for name, months in seasons.items():
        out.append(Derived(f"Sold_{name}", ("Mo.Sold",), lambda df, m=months: _flag(_q("Mo.Sold").isin(*m))))
    return out


def polynomial(cols: Sequence[str], degree: int = 2, interaction_only: bool = False, bias: bool = False) -> list[Column]:
    """Terms in the order: (1), originals, products of 2, 3, .. ``degree`` columns.

    ``interaction_only``: every column at most once in a product.
    """
    if degree < 1:
        raise ValueError("degree must be at least 1")
    chosen = combinations if interaction_only else combinations_with_replacement
    terms = [F.lit(1.0).alias("1")] if bias else []
    for d in range(1, degree + 1):
        terms += [reduce(lambda x, y: x * y, [col(c) for c in part]).alias("*".join(part)) for part in chosen(cols, d)]
    return terms


@dataclass(frozen=True)
class LogTransform:
    """log1p of the chosen columns, values below 0 taken as 0."""

    columns: tuple[str, ...]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str] | None, candidates: Sequence[str] = (), threshold: float = 0.5):
        """Without ``columns``: those of ``candidates`` with |skew| above the threshold."""
        if columns is None:
            columns = sorted(r.feature for r in skewed_columns(df, list(candidates), threshold).collect())
        return cls(tuple(columns))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: log1p_clipped(c) for c in self.columns if c in df.columns})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.expm1(c) for c in self.columns if c in df.columns})


@dataclass(frozen=True)
class TransactionFeatures:
    """Amount and time features with parameters learned at fit time."""

    median_amount: float
    max_time: float

    @classmethod
    def fit(cls, df: DataFrame, amount: str, seconds: str):
        median = quantile_values(df, [amount], [0.5])[amount, 0.5]
        return cls(median, df.agg(F.max(seconds).alias("m")).first().m)

    def transform(self, df: DataFrame, amount: str, seconds: str) -> DataFrame:
        hour = hour_of(seconds)
        sine, cosine = cyclic(hour, 24)
        return df.withColumns(
            {
                "amount_log": F.log1p(col(amount)),
                "hour": hour,
                "hour_sin": sine,
                "hour_cos": cosine,
                "amount_to_median": col(amount) / F.lit(self.median_amount + 1e-9),
                "is_micro": (col(amount) < 1.0).cast("int"),
                "time_norm": col(seconds) / F.lit(float(self.max_time)),
            }
        )


# fixed values: the original and its four one-cell moves
SHIFTS = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))


def shift_augment(df: DataFrame, grid: str, width: int, shifts=SHIFTS) -> DataFrame:
    """One row per shift from a single scan."""
    moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in shifts])
    out = df.select("*", F.inline(moves))
    return out.withColumn(grid, arrays.shift_grid(grid, width, F.col("dx"), F.col("dy")))


def add_noise(df: DataFrame, grid: str, key: str, high: int, seed: int, scale: float = 1.0) -> DataFrame:
    """Adds repeatable integer noise 0..high-1, scaled, to every cell."""
    noise = lambda x, i: x + F.pmod(F.xxhash64(col(key), i, F.lit(seed)), F.lit(high)) * scale
    return df.withColumn(grid, F.transform(grid, noise))


def centre_similarity(vector: str, centres: Sequence[Sequence[float]], gamma: float) -> list[Column]:
    """exp(-gamma * squared distance) to each centre of a fitted clustering."""
    out = []
    for i, c in enumerate(centres):
        point = F.array(*[F.lit(float(x)) for x in c])
        diff = F.zip_with(col(vector), point, lambda a, b: (a - b) * (a - b))
        out.append(F.exp(-gamma * F.aggregate(diff, F.lit(0.0), lambda s, x: s + x)).alias(f"cluster_{i}_similarity"))
    return out


@dataclass(frozen=True)
class ColumnTransform:
    """Named Column -> Column function with an optional inverse."""

    columns: tuple[str, ...]
    forward: Callable[[Column], Column]
    backward: Callable[[Column], Column] | None = None
    name: Callable[[str], str] = staticmethod(lambda c: c)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({self.name(c): self.forward(col(c)) for c in self.columns})

    def inverse(self, df: DataFrame) -> DataFrame:
        if self.backward is None:
            raise ValueError("no inverse given")
        return df.withColumns({c: self.backward(col(self.name(c))) for c in self.columns})

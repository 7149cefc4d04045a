"""Column roles: map any transaction table onto the names the operators use."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cols:
    """Source column for each role. Missing roles become NULL columns."""

    txn_id: str = "txn_id"
    customer_id: str = "customer_id"
    card: str = "card"
    ts: str = "ts"
    channel: str = "channel"
    product_cd: str = "product_cd"
    amt: str = "amt"
    risk_score: str = "risk_score"
    addr1: str = "addr1"
    device_profile: str = "device_profile"
    id_15: str = "id_15"
    id_23: str = "id_23"
    p_email: str = "p_email"
    r_email: str = "r_email"

    def standardize(self, df: DataFrame) -> DataFrame:
        """Rename role columns, derive ``ts_us`` and keep every other column."""
        have = set(df.columns)
        types = {"txn_id": "long", "amt": "double", "risk_score": "double", "ts": "timestamp"}
        out, used = [], set()
        for f in fields(self):
            src = getattr(self, f.name)
            kind = types.get(f.name, "string")
            col = F.col(src) if src in have else F.lit(None)
            out.append(col.cast(kind).alias(f.name))
            used.add(src)
        names = {f.name for f in fields(self)} | {"ts_us"}
        rest = [F.col(x) for x in df.columns if x not in used and x not in names]
        std = df.select(*out, *rest)
        return std.withColumn("ts_us", F.unix_micros("ts"))


def card_key(customer: str, *parts: str):
    """Card identity: customer and card parts joined by ``|``; missing parts become ``_``."""
    vals = [F.coalesce(F.col(p).cast("string"), F.lit("_")) for p in parts]
    return F.concat_ws("|", F.col(customer), *vals)


def is_proxied(col: str = "id_23"):
    return F.coalesce(F.col(col).startswith("IP_PROXY:"), F.lit(False))


def ts_from_us(col):
    return F.timestamp_micros(F.col(col) if isinstance(col, str) else col)


HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
SEC_US = 1_000_000
MONEY = "decimal(28,6)"


def exact_sum(col):
    """Sum of amounts in exact decimals: the same double for every order of addition."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast(MONEY)).cast("double")


def exact_mean(col):
    c = F.col(col) if isinstance(col, str) else col
    return exact_sum(c) / F.count(c)

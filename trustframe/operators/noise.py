"""Label poisoning as a column, and the seeded choice of attackers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trustframe.functions.hashing import keyed_md5, uniform_from_md5


def flip_labels(
    y: Column, malicious: Column, rate: float, row_key: Column, client: Column, round_no: Column, seed: int
) -> Column:
    """Flip a binary label of malicious clients with probability ``rate``; a new draw for each round and client.

    The hash is evaluated only for rows of malicious clients.
    """
    if rate <= 0:
        return y
    if rate >= 1:
        return F.when(malicious, 1 - y).otherwise(y)
    key = F.concat_ws(":", F.lit(int(seed)), round_no, client, row_key)
    draw = uniform_from_md5(F.md5(key.cast("binary")))
    return F.when(malicious & (draw < F.lit(float(rate))), 1 - y).otherwise(y)


def pick_clients(clients: DataFrame, k: int, seed: int, client: str = "client_id") -> DataFrame:
    """``k`` of the clients, the same ones for the same seed; none for k <= 0, all when there are no more than k."""
    distinct = clients.select(client).distinct()
    if k <= 0:
        return distinct.limit(0)
    digest = keyed_md5(F.col(client), int(seed))
    return distinct.orderBy(digest, client).limit(int(k))

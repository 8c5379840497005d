"""Two or three tables about the same invented things, with known truth and seeded noise."""

from __future__ import annotations

import random
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Scenario:
    """How many things, and how often each kind of noise occurs."""

    entities: int = 24
    left_only: int = 0
    right_only: int = 0
    duplicates: int = 0
    competitors: int = 0
    missing_left: float = 0.05
    missing_right: float = 0.20
    typo: float = 0.35
    date_shift: float = 0.20
    token_swap: float = 0.0
    date_swap: float = 0.0
    punctuation: float = 0.0
    zipf: float = 0.0
    mode: str = "link_only"  # or dedupe_only, multi_source
    seed: int = 1


_PARTS = "bal cor den fir gam hol jun kel lam mor nus pel ran sol tev vin wex yar zud".split()


def generate(spark: SparkSession, plan: Scenario) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables by data set (record_key, label_value, date_value, group_value) and the truth
    (dataset_id, record_key, entity_key, household_key); a household is three things in a row."""
    r = random.Random(plan.seed)
    names = {"link_only": ("a", "b"), "dedupe_only": ("a",), "multi_source": ("a", "b", "c")}[plan.mode]
    rows: dict[str, list] = {n: [] for n in names}
    truth: list[tuple] = []

    def word() -> str:
        return "".join(r.choice(_PARTS) for _ in range(2))

    def group() -> str:
        n = int(20 * r.random() ** (1 + 3 * plan.zipf))
        return f"group-{n}"

    def noisy(base: tuple, missing: float) -> tuple:
        label, day, code = base
        if r.random() < plan.typo:
            i = r.randrange(len(label))
            label = label[:i] + r.choice("abcdefgh") + label[i + 1:]
        if r.random() < plan.token_swap:
            label = " ".join(reversed(label.split(" ")))
        if r.random() < plan.punctuation:
            label = label.replace(" ", r.choice(["-", ", ", "/"]))
        if r.random() < plan.date_shift:
            day = day + timedelta(days=r.choice([-2, -1, 1, 2]))
        text = day.isoformat()
        if r.random() < plan.date_swap and day.day <= 12:
            text = f"{day.year:04d}-{day.day:02d}-{day.month:02d}"
        return tuple(None if r.random() < missing else v for v in (label, text, code))

    def put(side: str, entity: int, base: tuple, missing: float) -> None:
        key = f"{side}-{len(rows[side]):06d}"
        rows[side].append((key, *noisy(base, missing)))
        truth.append((side, key, f"e{entity}", f"h{entity // 3}"))

    total = plan.entities + plan.left_only + plan.right_only
    for e in range(total):
        base = (f"{word()} {word()}", date(1950, 1, 1) + timedelta(days=r.randrange(20_000)), group())
        only_left, only_right = plan.entities <= e < plan.entities + plan.left_only, e >= plan.entities + plan.left_only
        for i, side in enumerate(names):
            if (only_left and i > 0) or (only_right and i == 0 and len(names) > 1):
                continue
            put(side, e, base, plan.missing_left if i == 0 else plan.missing_right)
        if e < plan.duplicates:
            put(names[0], e, base, plan.missing_left)
        if e < plan.competitors:
            put(names[-1], total + e, (base[0], base[1] + timedelta(days=400), base[2]), plan.missing_right)
    schema = "record_key string, label_value string, date_value string, group_value string"
    tables = {n: spark.createDataFrame(rows[n], schema) for n in names}
    return tables, spark.createDataFrame(truth, "dataset_id string, record_key string, entity_key string, household_key string")

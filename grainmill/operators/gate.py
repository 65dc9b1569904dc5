"""The state gate: a verdict and seven checks from flag files, two JSON states and a JSONL log."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The flags' names and their files.
FLAGS = {
    "STOP_BY_USER": "STOP_BY_USER.flag",
    "FORCE_LOCK": "FORCE_LOCK",
    "FORCE_ITERATE": "FORCE_ITERATE",
    "LOCK_BY_ANTIDRIFT": "LOCK_BY_ANTIDRIFT",
    "LOCK_BY_GOV": "LOCK_BY_GOV",
}
TAIL = 50


def read_json(path: str) -> dict | None:
    """A JSON object, or None where it is missing or broken."""
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
    except (OSError, ValueError):
        return None
    return got if isinstance(got, dict) else None


def jsonl_tail(path: str, n: int = TAIL) -> list:
    """Of the last n lines that are not blank, those that are JSON."""
    try:
        with open(path, encoding="utf-8") as f:
            tail = [x for x in f if x.strip()][-n:]
    except OSError:
        return []
    out = []
    for line in tail:
        try:
            out.append(json.loads(line))
        except ValueError:
            continue
    return out


def read_state(spark: SparkSession, civ_dir: str = "CIV", flags_dir: str = ".", micro: str = "latest_trinity_micro_event.json") -> DataFrame:
    """One row of the gate's inputs; small files on the driver."""
    row = {name.lower(): os.path.isfile(os.path.join(flags_dir, file)) for name, file in FLAGS.items()}
    state, event = read_json(os.path.join(civ_dir, "civ_state.json")), read_json(micro)
    row |= {"state_id": 0, "micro_event": None if event is None else json.dumps(event), "civ_state": None if state is None else json.dumps(state), "chronicle": [json.dumps(x) for x in jsonl_tail(os.path.join(civ_dir, "chronicle.jsonl"))]}
    schema = "state_id long, stop_by_user boolean, force_lock boolean, force_iterate boolean, lock_by_antidrift boolean, lock_by_gov boolean, micro_event string, civ_state string, chronicle array<string>"
    return spark.createDataFrame([tuple(row[x.split()[0]] for x in schema.split(", "))], schema)


def triage(states: DataFrame) -> DataFrame:
    """state_id, verdict, seven checks and gate for rows of inputs; an existing but empty event counts as existing."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    checks = {
        "no_stop": no("stop_by_user"), "no_gov_lock": no("lock_by_gov"), "no_force_lock": no("force_lock"), "no_antidrift": no("lock_by_antidrift"),
        "has_event": F.col("micro_event").isNotNull(), "has_state": F.col("civ_state").isNotNull(), "has_log": F.coalesce(F.size("chronicle"), F.lit(0)) > 0,
    }
    verdict = F.when(~checks["no_stop"], "STOPPED_BY_USER").when(~checks["no_gov_lock"], "LOCK_BY_GOV").when(~checks["no_force_lock"] | ~checks["no_antidrift"], "MASKED_SERVICE").when(~checks["has_event"], "NO_MICRO_EVENT").otherwise("MOVING")
    every = checks["no_stop"]
    for c in checks.values():
        every &= c
    return states.select("state_id", verdict.alias("verdict"), *(c.alias(k) for k, c in checks.items()), F.when(every, "PASS").otherwise("FAIL").alias("gate"))


def report(states: DataFrame) -> DataFrame:
    """state_id and the verdict, checks and gate as JSON."""
    out = triage(states)
    return out.select("state_id", F.to_json(F.struct(*(c for c in out.columns if c != "state_id"))).alias("report"))

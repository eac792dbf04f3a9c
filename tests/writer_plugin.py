"""Example user writer for the custom writer sink (runs on executors)."""

import json
import os
import uuid


def write(rows, out="/tmp", **_):
    with open(os.path.join(out, f"w-{uuid.uuid4().hex}.jsonl"), "w") as f:
        for r in rows:
            f.write(json.dumps({"name": r["name"], "meta": r["meta"], "value": r["value"]}) + "\n")

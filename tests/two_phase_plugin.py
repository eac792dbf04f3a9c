"""Example writer with two phases: files in a staging folder, renamed at commit."""

import json
import os
import uuid


class _Plugin:
    @staticmethod
    def stage(rows, out="/tmp", fail_once="", **_):
        name = f"{uuid.uuid4().hex}.jsonl"
        os.makedirs(f"{out}/staging", exist_ok=True)
        with open(f"{out}/staging/{name}", "w") as f:
            for r in rows:
                f.write(json.dumps({"name": r["name"], "meta": r["meta"], "value": r["value"]}) + "\n")
        if fail_once:   # after the rows were written
            try:
                os.close(os.open(f"{out}/{fail_once}", os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return name
            raise OSError("this attempt fails")
        return name

    @staticmethod
    def commit(tokens, batch_id, out="/tmp", **_):
        done = f"{out}/batch-{batch_id}"
        if os.path.exists(done):
            return
        os.makedirs(f"{done}.new", exist_ok=True)
        for t in tokens:
            os.rename(f"{out}/staging/{t}", f"{done}.new/{t}")
        os.rename(f"{done}.new", done)

    @staticmethod
    def abort(tokens, batch_id, out="/tmp", **_):
        for t in tokens:
            os.remove(f"{out}/staging/{t}")


plugin = _Plugin()

import hashlib

import duckdb
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from lagscope.llm import chat as C
from tests.llm.helpers import table

EVENTS = "conv string, msg string, seq bigint, kind string, role string, text string"
nasty = st.text(alphabet="<\\|n\nai_>é", max_size=12)


@settings(max_examples=400, deadline=None)
@given(nasty)
def test_escapes_are_reversible(text):
    assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)
    role = C.escape_role(text)
    assert C.unescape_role(role) == text and "<|" not in role and "\n" not in role


def compare(spark, df):
    conversations = pa.Table.from_pylist([r.asDict() for r in df.collect()], schema=pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    want = duckdb.connect().register("conversations", conversations).sql(C.ORACLE_SQL).fetchall()
    got = C.op10(spark, df)
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    return want


def test_whole_table_against_sql(spark):
    assert len(compare(spark, table(spark, "conversations", "sf0.01"))) > 100


def test_edges_against_sql(spark):
    convs = table(spark, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([
        (9001, 0, "us<n|er\nx", "<\\|a<|b"), (9001, None, None, None), (9002, 5, "assistant", ""),
        (9001, 0, "assistant", "é😀<\\\\|"), (9001, 0, "assistant", "é😀<\\\\|"), (None, 1, "user", "q"),
        (None, 2, "assistant", "q" * 200_000), (-1, 7, "user", "z"), ((1 << 53) + 1, 0, "user", "big id")], convs.schema)
    compare(spark, odd)
    probe = compare(spark, convs.limit(0))
    assert [(r[0], r[1]) for r in probe] == [(-1, 2)]
    assert probe[0][2] == hashlib.sha256("".join(f"{r}\n{C.PROBE}\n" for r in ("user", "assistant")).encode()).hexdigest()


def brute_fold(events):
    """One event after the other on a list of messages."""
    out = {}
    for conv, msg, seq, kind, role, text in sorted(events, key=lambda e: e[2]):
        log = out.setdefault(conv, [])
        at = next((i for i, m in enumerate(log) if m[0] == msg), None)
        if kind == "regenerate":
            if at is not None:
                del log[at:]
        elif at is None:
            if kind != "edit":
                log.append([msg, seq, role, text])
        elif kind == "delta":
            log[at][3] += text
        else:
            log[at][3] = text
    return sorted((c, m[1], m[2], m[3]) for c, log in out.items() for m in log)


def test_log_of_deltas_edits_and_regenerations(spark):
    import random
    rng = random.Random(8)
    events = []
    for conv in "abcd":
        made, seq = [], 0
        for step in range(60):
            seq += rng.randint(1, 3)
            kind = rng.choice(("message", "delta", "delta", "edit", "regenerate"))
            if kind in ("message", "delta") and (not made or rng.random() < 0.5):
                made.append(f"{conv}{step}")
                events.append((conv, made[-1], seq, kind, rng.choice(("user", "assistant")), f"t{step}"))
            elif made:
                msg = rng.choice(made)
                events.append((conv, msg, seq, kind, None, f"t{step}"))
                if kind == "regenerate":
                    del made[made.index(msg):]
            else:
                events.append((conv, "unknown", seq, "edit", None, "nothing"))
    want = brute_fold(events)
    rng.shuffle(events)
    got = C.fold(spark.createDataFrame(events, EVENTS))
    assert sorted(map(tuple, got.collect())) == want


def test_rendered_text_and_mask(spark):
    events = spark.createDataFrame([("c", "1", 1, "message", "system", "be <|kind|>"), ("c", "2", 2, "message", "user", "hi"),
                                    ("c", "3", 3, "delta", "assistant", "good "), ("c", "3", 4, "delta", None, "day")], EVENTS)
    rows = C.render(C.fold(events)).orderBy("position").collect()
    whole = "".join(r.segment for r in rows)
    assert whole == ("<|im_start|>system\nbe <\\|kind|><|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
                     "<|im_start|>assistant\ngood day<|im_end|>\n")
    assert [r.start for r in rows] == [whole.index(r.segment) for r in rows]
    assert [whole[r.loss_start:r.loss_end] for r in rows if r.loss_start is not None] == ["good day"]


def test_ids_used_again_after_a_regeneration(spark):
    """Regenerated and removed ids come back, as do equal ids in other
    conversations; the log in order is the reference."""
    import random
    rng = random.Random(5)
    events = [("r", "q", 1, "message", "user", "hi"), ("r", "a", 2, "message", "assistant", "old"),
              ("r", "a", 3, "regenerate", None, None), ("r", "a", 4, "delta", "assistant", "ne"),
              ("r", "a", 5, "delta", None, "w")]
    for conv in ("a", "b", "c", "d", None):
        seq = 0
        for step in range(120):
            seq += rng.randint(1, 3)
            kind = rng.choices(("message", "delta", "edit", "regenerate"), (3, 4, 2, 1))[0]
            events.append((conv, f"m{rng.randrange(9)}", seq, kind, rng.choice(("user", "assistant")), f"t{step} "))
    plain = [e[:4] + (None if e[3] in ("delta", "edit") and i > 4 and i % 2 else e[4],) + e[5:] for i, e in enumerate(events)]
    want = final(plain)
    assert ("r", 4, "assistant", "new") in want and len(want) > 10
    rng.shuffle(plain)
    assert sorted(map(tuple, C.fold(spark.createDataFrame(plain, EVENTS)).collect()), key=repr) == want


def final(events):
    """``brute_fold`` with roles: a later message or edit may bring one."""
    out = {}
    for conv, msg, seq, kind, role, text in sorted(events, key=lambda e: e[2]):
        log = out.setdefault(conv, [])
        at = next((i for i, m in enumerate(log) if m[0] == msg), None)
        if kind == "regenerate":
            if at is not None:
                del log[at:]
        elif at is None:
            if kind != "edit":
                log.append([msg, seq, role or "", text])
        elif kind == "delta":
            log[at][3] += text
        else:
            log[at][2:] = [role or log[at][2], text]
    return sorted(((c, m[1], m[2], m[3]) for c, log in out.items() for m in log), key=repr)


def test_events_without_id_and_of_equal_sequence(spark):
    events = [("c", None, 1, "message", "user", "same"), ("c", None, 1, "message", "user", "same"),
              ("c", "a", 2, "message", "assistant", "x"), ("c", None, 3, "message", "user", "gone"),
              ("c", "b", 4, "message", "user", "tie"), ("c", "a", 4, "regenerate", None, None),
              ("c", None, 5, "message", "user", "gone"), ("c", None, 6, "edit", "user", "nothing")]
    got = sorted(map(tuple, C.fold(spark.createDataFrame(events, EVENTS)).collect()))
    # a regeneration comes after the messages of its own sequence number
    assert got == [("c", 1, "user", "same"), ("c", 1, "user", "same"), ("c", 5, "user", "gone")]

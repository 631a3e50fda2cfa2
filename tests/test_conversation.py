"""The log of requests against a loop that keeps it."""

import random

import pytest

from parley.operators import conversation

SEGMENT = "meeting_id long, at long, id string, label string, start_ms long, text string, is_final boolean"
NAME = "meeting_id long, at long, label string, name string"
RELABEL = "meeting_id long, at long, id string, label string"
REQUEST = "meeting_id long, n long, at long, done_at long, kind string, ok boolean, task string, reply string, summary string, most_chars long"


def plain_name(label):
    return {"sys:1": "Участник 1", "sys:2": "Участник 2", "me": "Я", None: "?"}[label]


def line(start, name, text):
    return f"[{start // 60_000:02}:{start // 1000 % 60:02}] {name}: {text.strip()}"


def loop(segments, names, relabels, requests, context=0):
    """One meeting's log kept step by step; n -> (parent, epoch, text, lines, dropped, notes, prompt_chars)."""
    steps = [(s[1], 0, "final", s) for s in segments] + [(x[1], 0, "name", x) for x in names] + [(x[1], 0, "label", x) for x in relabels]
    steps += [(q[2], 1, "ask", q) for q in requests] + [(q[3], 0, "done", q) for q in requests if q[3] is not None and q[4] == "live"]
    finals, called, pending, told, turns, out, flying, epoch, version = {}, {}, [], {}, [], {}, None, 0, None
    now = lambda label: (called.get(label) or "").strip() or plain_name(label)

    def update(ids, known):
        notes = [(x, f"{known[x]} — снова {now(x)} (имя снято)." if now(x) == plain_name(x) else f"{known[x]} теперь зовут {now(x)}.") for x in known if known[x] != now(x)]
        rows = sorted((finals[i][2], i, finals[i]) for i in ids)
        after = {x: now(x) for x in known} | {r[1]: now(r[1]) for _, _, r in rows if r[1] is not None}
        blocks = ["<speaker_names>\n" + "\n".join(n for _, n in sorted(notes, key=lambda n: (n[0] != "me", n[0]))) + "\n</speaker_names>"] if notes else []
        blocks += ["<transcript_update>\n" + "\n".join(line(s, now(r[1]), r[3]) for s, _, r in rows) + "\n</transcript_update>"] if rows else []
        return blocks, after, len(notes)

    for _, _, kind, x in sorted(steps, key=lambda s: s[:2]):
        if kind == "final" and x[6] and x[5].strip() and x[2] not in finals:
            finals[x[2]] = [x[1], x[3], x[4], x[5]]
            pending.append(x[2])
        elif kind == "name":
            called[x[2]] = x[3]
        elif kind == "label" and x[2] in finals:
            finals[x[2]][1] = x[3]
        elif kind == "done" and flying and flying[0] == x[1]:
            n, ids, before, text = flying
            flying = None
            if x[5]:
                turns += [text, x[7].strip()]
                version = n
            else:
                told, pending = before, ids + pending
        elif kind == "ask":
            n = x[1]
            if x[4] == "rollover":
                rows, used, kept = sorted(((r[2], i, r) for i, r in finals.items()), reverse=True), 0, []
                for s, i, r in rows:
                    size = len(line(s, now(r[1]), r[3])) + 1
                    if kept and used + size > x[9]:
                        break
                    used += size
                    kept.append((s, i, r))
                parts = [conversation.LONG_AGO if len(kept) < len(rows) else conversation.UNDER_WAY]
                parts += [f"<summary_so_far>\n{x[8].strip()}\n</summary_so_far>"] if x[8] else [conversation.NO_SUMMARY] if len(kept) < len(rows) else []
                parts.append("<recent_transcript>\n" + ("\n".join(line(s, now(r[1]), r[3]) for s, _, r in reversed(kept)) or conversation.NOTHING_YET) + "\n</recent_transcript>")
                text = "<earlier_in_meeting>\n" + "\n".join(parts) + "\n</earlier_in_meeting>"
                out[n] = (version, epoch, text, len(kept), len(rows) - len(kept), 0, len(text) + context)
                told = {k: now(k) for k in told} | {r[1]: now(r[1]) for _, _, r in kept if r[1] is not None}
                turns, pending, epoch, version = [text], [], epoch + 1, n
                continue
            ids, known = (flying[1] + pending, flying[2]) if flying and x[4] == "fork" else (pending, told)
            blocks, after, notes = update(ids, known)
            text = "\n".join([*blocks, x[6]])
            out[n] = (version, epoch, text, len(ids), 0, notes, sum(map(len, turns)) + len(text) + context)
            if x[4] == "live":
                flying, pending, told = (n, ids, told, text), [], after
    return out


def compared(spark, segments, names, relabels, requests, bucket=10_000, context=0):
    found = conversation.conversation(spark.createDataFrame(segments, SEGMENT), spark.createDataFrame(names, NAME), spark.createDataFrame(relabels, RELABEL), spark.createDataFrame(requests, REQUEST), context, bucket)
    got = {(r.meeting_id, r.n): (r.parent, r.epoch, r.text, r.lines, r.dropped, r.notes, r.prompt_chars) for r in found.collect()}
    want = {}
    for m in {q[0] for q in requests}:
        own = lambda rows: [r for r in rows if r[0] == m]
        want |= {(m, n): v for n, v in loop(own(segments), own(names), own(relabels), own(requests), context).items()}
    assert got == want
    return got


def request(n, at, done, kind="live", ok=True, most=None, summary=None):
    return (1, n, at, done, kind, ok, f"<task>{n}</task>", " ответ ", summary, most)


def test_a_failed_request_leaves_its_lines_to_the_next(spark):
    said = [(1, 1, "a", "sys:1", 3000, "о сроках", True), (1, 2, "a", "sys:1", 3000, "ещё раз", True), (1, 3, "b", "me", 1000, "начнём", True), (1, 4, "c", "me", 1, " ", True), (1, 5, "d", "me", 1, "нет", False)]
    got = compared(spark, said, [(1, 15, "sys:1", "Ольга")], [], [request(1, 10, 12, ok=False), request(2, 20, 22), request(3, 30, None), request(4, 40, 41)])
    assert got[1, 1][2] == "<transcript_update>\n[00:01] Я: начнём\n[00:03] Участник 1: о сроках\n</transcript_update>\n<task>1</task>"
    assert got[1, 2][0] is None and "Ольга: о сроках" in got[1, 2][2] and not got[1, 2][5]
    assert got[1, 3][:1] == got[1, 4][:1] == (2,) and got[1, 4][2] == "<task>4</task>"


def test_forks_add_lines_in_flight_and_leave_no_version(spark):
    said = [(1, k, f"s{k}", "sys:1", k * 1000, f"реплика {k}", True) for k in (1, 15, 25)]
    got = compared(spark, said, [(1, 16, "sys:1", "Ольга")], [], [request(1, 10, 12), request(2, 20, 30), request(3, 26, 27, "fork"), request(4, 40, 41)])
    assert got[1, 3][0] == 1 and got[1, 3][3] == 2 and got[1, 3][5] == 1
    assert got[1, 4][0] == 2 and got[1, 4][3] == 1 and got[1, 4][5] == 0


def test_rollovers_start_anew(spark):
    said = [(1, k, f"s{k:02}", "sys:1" if k % 2 else "sys:2", k * 1000, "слово " * 3, True) for k in range(1, 20)]
    asked = [request(1, 5, 6), request(2, 11, 11, "rollover", most=70, summary=" итог "), request(3, 13, 14), request(4, 16, 16, "rollover", most=0), request(5, 30, 31)]
    got = compared(spark, [(m, a + (a > 10), *x) for m, a, *x in said], [(1, 9, "sys:2", "Пётр"), (1, 15, "sys:2", " ")], [(1, 8, "s01", "me")], asked, context=100)
    assert got[1, 2][4] > 0 and "<summary_so_far>\nитог\n</summary_so_far>" in got[1, 2][2] and got[1, 4][3] == 1 and conversation.NO_SUMMARY in got[1, 4][2]
    assert got[1, 5][1] == 2 and got[1, 5][0] == 4


@pytest.mark.parametrize("bucket", [7, 10_000])
def test_random_logs(spark, bucket):
    rng = random.Random(bucket)
    segments, names, relabels, requests = [], [], [], []
    for m in range(1, 9):
        at, busy = 0, 0
        for n in range(70):
            at += 2
            kind = rng.random()
            if kind < 0.5:
                segments.append((m, at, f"s{rng.randrange(60)}", rng.choice(["sys:1", "sys:2", "me", None]), rng.randrange(90_000), rng.choice(["да", " нет ", "", "долгая реплика о сроках"]), rng.random() < 0.9))
            elif kind < 0.6:
                names.append((m, at, rng.choice(["sys:1", "sys:2"]), rng.choice(["Ольга", "Пётр", " ", None])))
            elif kind < 0.65:
                relabels.append((m, at, f"s{rng.randrange(60)}", rng.choice(["sys:1", "sys:2", "me", None])))
            elif kind < 0.75:
                requests.append((m, n, at, at + 1, "fork", True, "f", "r", None, None))
            elif at > busy:
                if rng.random() < 0.25:
                    requests.append((m, n, at, at, "rollover", True, "", None, rng.choice([None, "итог"]), rng.choice([0, 60, 10_000])))
                else:
                    busy = at + rng.choice([1, 1, 5])
                    requests.append((m, n, at, busy, "live", rng.random() < 0.7, f"t{n}", " ответ ", None, None))
    assert len(compared(spark, segments, names, relabels, requests, bucket, 10)) > 100


def test_empty(spark):
    empty = [spark.createDataFrame([], s) for s in (SEGMENT, NAME, RELABEL, REQUEST)]
    assert conversation.conversation(*empty).count() == 0

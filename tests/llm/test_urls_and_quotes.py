"""The native operators: URL rules and models, and quotation threads."""

import random
import re

from corrob.llm import quotes, urls


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(rows)], "page_id long, url string, html string, score double")


def parts_by_hand(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:n], rest[n:]
    n = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:n]


URLS = [None, "", "no scheme", "http://A.Example.NET/en/1", "http://example.net/en", "http://net/x", "http://bnet/x", "http://x.net", "http://x.net?/a", "https://q.org/fr/1#y", "https://q.org/de/1",
        "http://m.example.com/de/?x=://", "a://b://c.net/d", "http://ÀB.Org/fr/", "://net/", "http://x.com/" + "y" * 20_000, "http://x.com/\nz"]


def test_hosts_paths_and_rules(spark):
    got = {r["page_id"]: r for r in urls.judge(pages(spark, URLS)).collect()}
    for i, u in enumerate(URLS):
        host, path = parts_by_hand(u)
        fits = [r for r, _ in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == dict(urls.RULES).get(rule, got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    assert urls.judge(pages(spark, URLS).limit(0)).count() == 0


def test_model_generalises_and_no_labels_allow(spark):
    bad = [f"http://s{i}.net/cheap-pills-{i}" for i in range(60)]
    good = [f"http://s{i}.org/fr/article-{i}" for i in range(60)]
    new = ["http://q.com/cheap-pills-7", "http://q.com/article-7"]
    got = {r["url_id"]: r["verdict"] for r in urls.judge(pages(spark, bad + good + new)).selectExpr("page_id as url_id", "verdict").collect()}
    assert got[120] == "block" and got[121] == "allow"
    assert {r["verdict"] for r in urls.judge(pages(spark, new)).collect()} == {"allow"}


def score_by_hand(rows, fits):
    """The score of each URL by recursion over dictionaries. fits: (url, 'allow' or 'block') to train on."""
    import math

    symbols = lambda u: urls.START * urls.ORDER + "".join(c.lower() if "A" <= c <= "Z" else c for c in u) + urls.END
    seen = {"allow": {}, "block": {}}
    for u, v in fits:
        s = symbols(u)
        for i in range(urls.ORDER, len(s)):
            for k in range(urls.ORDER + 1):
                after = seen[v].setdefault(s[i - k : i], {})
                after[s[i]] = after.get(s[i], 0) + 1

    def p(v, context, c):
        low = p(v, context[1:], c) if context else urls.UNIFORM
        after = seen[v].get(context, {})
        n = sum(after.values())
        return (after.get(c, 0) + len(after) * low) / (n + len(after)) if n else low

    out = []
    for u in rows:
        s = symbols(u) if u is not None else ""
        q = [math.floor((math.log(p("allow", s[i - urls.ORDER : i], s[i])) - math.log(p("block", s[i - urls.ORDER : i], s[i]))) * 1e6 + 0.5) for i in range(urls.ORDER, len(s))]
        out.append(sum(q) / len(q) / 1e6 if q else 0.0)
    return out


def test_scores_equal_models_by_hand_and_tell_digits_and_scripts_apart(spark):
    import hashlib

    bad = [f"http://s{i}.net/777{i}77/плохо{i}" for i in range(40)]
    good = [f"http://s{i}.org/fr/333{i}33/добро{i}" for i in range(40)]
    new = ["http://q.com/777777", "http://q.com/333333", "http://q.com/плохо", "http://q.com/добро", None, "", "HTTP://Q.COM/" + "x" * 5000]
    rows = bad + good + new
    first = lambda u: hashlib.md5(u.encode()).hexdigest()[0] < "4"
    want = score_by_hand(rows, [(u, "block") for u in [*bad, rows[0]] if not first(u)] + [(u, "allow") for u in good if not first(u)])
    for most in (200_000, 7):
        got = {r["page_id"]: r for r in urls.judge(pages(spark, [*rows, rows[0]]), most_broadcast=most).collect()}
        assert all(abs(got[i]["score"] - w) < 2e-6 for i, w in enumerate(want))
    score = [got[80 + i]["score"] for i in range(4)]
    assert score[0] < score[1] - 0.5 and score[2] < score[3] - 0.5, score


def talk(spark, rows):
    return spark.createDataFrame([(*r, 5, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, hash string")


def test_quotes_link_to_the_latest_earlier_message(spark):
    rows = [
        (1, 0, "user", "How are you?\nTell me more."),
        (1, 1, "assistant", "Fine, thanks."),
        (1, 2, "user", "> how ARE you\n> tell me more\n\nI asked that."),
        (1, 3, "assistant", ">> How are you?\n>> Tell me more.\n> I asked that.\nYes, you did."),
        (1, 4, "user", "> not said by anyone\nHm."),
        (1, 5, "user", "> Fine,  thanks.\n"),
        (1, 6, "assistant", "Fine, thanks."),
        (1, 7, "user", "> Fine, thanks.\nGood."),
        (2, 0, "user", "> Yes, you did.\nOther talk."),
        (None, 1, "user", "> How are you?"),
        (3, None, None, None),
        (4, 0, "user", "> \n>\n"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.threads(talk(spark, [*rows, rows[0]])).collect()}
    assert len(got) == len(rows) and quotes.threads(talk(spark, [*rows, rows[0]])).count() == len(rows)
    parent = {k[1]: r["parent_turn"] for k, r in got.items() if k[0] == 1}
    assert parent == {0: None, 1: None, 2: 0, 3: 2, 4: None, 5: 1, 6: None, 7: 6}
    assert got[1, 3]["thread_root"] == 0 and got[1, 3]["depth"] == 2 and got[1, 3]["position"] == 2 and got[1, 3]["body"] == "Yes, you did."
    assert got[1, 5]["body"] == "" and got[2, 0]["parent_turn"] is None and got[None, 1]["parent_turn"] is None
    assert [got[1, t]["position"] for t in (0, 2, 3)] == [0, 1, 2] and got[1, 7]["thread_root"] == 6
    assert quotes.threads(talk(spark, rows).limit(0)).count() == 0


def norm_by_hand(t):
    return " ".join(re.findall(r"[^\W_]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)))


def passages_by_hand(text):
    """{(level, normalised passage)} of one message, line by line."""
    lines = []
    for line in (text or "").split("\n"):
        m = re.match(r"[ \t]*>[> \t]*", line)
        lines.append((m[0].count(">") if m else 0, line[m.end() :] if m else line))
    out, runs, last = set(), [], None
    for level, raw in lines:
        if not norm_by_hand(raw):
            last = None
            continue
        if level != last:
            runs.append((level, []))
        runs[-1][1].append(raw)
        last = level
        out.add((level, norm_by_hand(raw)))
    for level, raws in runs:
        out.add((level, norm_by_hand(" ".join(raws))))
        out |= {(level, norm_by_hand(x)) for x in re.split(r"(?<=[.!?。！？])\s+", " ".join(raws))}
    for level in {k for k, _ in runs}:
        out.add((level, norm_by_hand(" ".join(r for k, raws in runs if k == level for r in raws))))
    return {(k, x) for k, x in out if x}


def parents_by_hand(rows):
    out = {}
    for conv, turn, _, text in rows:
        best = None
        for level, said in passages_by_hand(text):
            fits = [t for c, t, _, x in rows if c == conv and t < turn and (0, said) in passages_by_hand(x)]
            if level and fits:
                best = max(filter(None, [best, (-level, len(said), max(fits))]))
        out[conv, turn] = best and best[2]
    return out


def test_parts_of_messages_link(spark):
    rows = [
        (1, 0, "user", "The first line.\nThe second one is here. And a third sentence\nthat goes on."),
        (1, 1, "assistant", "> The first line.\nYes."),
        (1, 2, "user", "On Monday Ann wrote:\n> And a third\n> sentence that goes on.\nNo."),
        (1, 3, "user", "Am Montag schrieb Ann:\n\n> No.\n\nSo Ann wrote:\nher book."),
        (1, 4, "user", "> Yes.\n> The first line.\nHm."),
    ]
    got = {r["turn"]: r for r in quotes.threads(talk(spark, rows)).collect()}
    assert {t: r["parent_turn"] for t, r in got.items()} == {0: None, 1: 0, 2: 0, 3: 2, 4: 0}
    assert got[2]["body"] == "No." and got[3]["body"] == "So Ann wrote:\nher book."


def test_parents_equal_brute_force(spark, monkeypatch):
    rng = random.Random(17)
    monkeypatch.setattr(quotes, "CELL", 4)
    rows = []
    for conv in range(6):
        said = []
        for turn in range(25):
            text = ""
            for _ in range(rng.randrange(0, 3)):
                if said:
                    part = rng.choice(said).split("\n")
                    a = rng.randrange(len(part))
                    text += "\n".join(rng.choice([">", "> ", ">> ", " > > "]) + x for x in part[a : a + rng.randrange(1, 4)]) + "\n"
            text += "\n".join(" ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(1, 4))) + rng.choice(["", ".", "!"]) for _ in range(rng.randrange(0, 4)))
            said.append(text)
            rows.append((conv, turn, "user", text))
    got = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in quotes.threads(talk(spark, rows)).collect()}
    assert got == parents_by_hand(rows) and sum(v is not None for v in got.values()) > 40


def test_very_long_messages(spark):
    line = "one statement of many"
    rows = [(1, 0, "user", "\n".join(f"{line} {i}." for i in range(20_000))), (1, 1, "user", f"> {line} 19999.\nok")]
    got = {r["turn"]: r for r in quotes.threads(talk(spark, rows)).collect()}
    assert got[1]["parent_turn"] == 0 and got[1]["body"] == "ok" and len(got[0]["body"]) == len(rows[0][3])


def test_long_chain_of_answers(spark):
    rows = [(9, 0, "user", "statement number 0")] + [(9, i, "user", f"> statement number {i - 1}\nstatement number {i}") for i in range(1, 40)]
    got = {r["turn"]: r for r in quotes.threads(talk(spark, rows)).collect()}
    assert all(got[i]["thread_root"] == 0 and got[i]["depth"] == i and got[i]["position"] == i and got[i]["parent_turn"] == (i - 1 if i else None) for i in range(40))
    lines = quotes.chat_lines(quotes.threads(talk(spark, rows))).where("position = 3").collect()
    assert lines[0]["line"] == "<|user|>\nstatement number 3"


def test_blanks_in_messages_take_linear_time(spark):
    import time

    df = spark.createDataFrame([(1, 1, "user", "a" + " " * 500_000 + "b\n" + "\n \t" * 200_000), (1, 2, "user", "> a\n\n" + " \x0b\n" * 200_000 + "answer")], "conv_id long, turn long, role string, text string")
    start = time.time()
    rows = df.select("turn", quotes.body_of(df["text"]).alias("b")).orderBy("turn").collect()
    assert time.time() - start < 20 and rows[0]["b"] == "a" + " " * 500_000 + "b" and rows[1]["b"] == "answer"

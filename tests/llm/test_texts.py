"""Quality, personal data, chat, mixing and toxicity."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeweave.llm import chat, mixing, pii, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(table, odd_rows):
    rows = [*odd_rows, (20, "a b c a b c d\nx\nx\n \nx"), (21, "a a a a"), (22, "p q r p q r p q")]
    got = quality.verdicts(table(rows)).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == sorted(brute_measures(r[1]) for r in rows)


def test_quality_keeps_columns_and_takes_an_empty_table(table, odd_rows):
    docs = table(odd_rows)
    assert quality.passing(docs).columns == docs.columns
    assert quality.verdicts(table([])).count() == 0


def test_quality_uses_no_python(spark, sf_dir):
    plan = quality.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.co", "x", "@", ".", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "+49 30 1234567", "+", " ", "-", "12", "é", "at", "9"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute_base(text)
    assert pii.spans(text)[0] == brute_base(text)


def test_base_spans_of_the_sample(spark, sf_dir):
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        assert pii.base_spans(row["text"] or "") == brute_base(row["text"] or "")


@pytest.mark.parametrize(
    ("text", "kind", "covered"),
    [
        ("write to jane [at] example [dot] com now", 0, "jane [at] example [dot] com"),
        ("write to jane dot doe at example dot org now", 0, "jane dot doe at example dot org"),
        ("jаne@exаmple.com", 0, "jаne@exаmple.com"),
        ("host 10 dot 0 dot 0 dot 7 is up", 1, "10 dot 0 dot 0 dot 7"),
        ("call +four nine three zero one two three four five six seven", 3, "+four nine three zero one two three four five six seven"),
        ("ring ＋４９ ３０ １２３４５６７ please", 3, "＋４９ ３０ １２３４５６７"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, covered):
    base, more = pii.spans(text)
    assert (kind, covered) in [(k, text[s:e]) for k, s, e in base + more]
    assert covered not in pii.redact(text)


@pytest.mark.parametrize(
    ("kind", "covered"),
    [
        (0, "j\u0430ne@example.com"),
        (0, "jane@mail.c\u043em"),
        (0, "jane@mail.example dot com"),
        (0, "jane dot doe@mail.example dot com"),
        (3, "+49 30 12345 six seven"),
    ],
)
def test_disguises_that_hold_a_base_span_are_covered_whole(kind, covered):
    text = f"write to {covered}, or a@b.co"
    base, more = pii.spans(text)
    assert base == brute_base(text)
    assert len(base) == 2
    assert [(k, text[s:e]) for k, s, e in more] == [(kind, covered)]
    assert pii.redact(text) == f"write to [{pii.KINDS[kind].upper()}], or [EMAIL]"


@pytest.mark.parametrize("text", ["meet at noon. The dot was red", "one two buckle my shoe", "look at example com", "we at home dot it", ""])
def test_plain_prose_has_no_spans(text):
    assert pii.spans(text) == ([], [])


@pytest.mark.parametrize("text", [" " * 1_000_000, "(" + " " * 1_000_000, "a dot " * 170_000, "a@a dot " * 120_000, "a at " * 200_000, "[at] " * 200_000, "1 dot " * 160_000, "one " * 250_000, "+1" + " " * 1_000_000, "1" * 1_000_000, "a." * 500_000, "a at b" + " dot b" * 160_000, "double " * 140_000])
def test_a_megabyte_of_anything_takes_little_time(text):
    began = time.time()
    pii.spans(text)
    assert time.time() - began < 3 if len(text.split()) > 2 else time.time() - began < 1


def disguised(rng, kind):
    """(text, start, end): an identifier that only its rewritten form shows."""
    letters = lambda n: "".join(rng.choice("abcdeghiklmnoprstuvwxyz") for _ in range(n))
    like = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "x": "х", "i": "і"}
    words = "zero one two three four five six seven eight nine".split()
    if kind == "email":
        user, host, end = letters(6) + "a", letters(5) + "o", rng.choice(pii.PLAIN_ENDS)
        own = rng.choice([f"{user} [at] {host} [dot] {end}", f"{user}(at){host}(dot){end}", f"{user} at {host} dot {end}", f"{user}@{host} dot {end}", "".join(like.get(c, c) for c in user) + f"@{host}.{end}", f"{user}＠{host}．{end}", f"{user}\u200b@{host}.{end}"])
    elif kind == "ip":
        parts = [str(rng.randrange(256)) for _ in range(4)]
        own = rng.choice([" dot ".join(parts), "[.]".join(parts), "(dot)".join(parts), "".join(chr(0xFF10 + int(c)) if c.isdigit() else "．" for c in ".".join(parts))])
    elif kind == "card":
        digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
        digits += next(c for c in "0123456789" if pii.luhn(digits + c))
        own = rng.choice([" ".join(words[int(c)] for c in digits), "".join(chr(0xFF10 + int(c)) for c in digits), "–".join(digits[k : k + 4] for k in range(0, 16, 4)), digits[:12] + " " + " ".join(words[int(c)] for c in digits[12:])])
    else:
        digits = "".join(str(rng.randrange(1, 10)) for _ in range(11))
        own = rng.choice(["+" + " ".join(words[int(c)] for c in digits), "plus " + " ".join(words[int(c)] for c in digits), "＋" + digits, "+" + digits[:8] + " " + " ".join(words[int(c)] for c in digits[8:])])
    before = " ".join(letters(4) for _ in range(rng.randrange(4))) + " so "
    return before + own + ", " + letters(5), len(before), len(before) + len(own)


@pytest.mark.parametrize("kind", pii.KINDS)
def test_planted_disguises_are_found(kind):
    rng = random.Random(kind)
    hit = 0
    for _ in range(400):
        text, a, b = disguised(rng, kind)
        base, more = pii.spans(text)
        hit += (pii.KINDS.index(kind), a, b) in base + more
    assert hit >= 0.95 * 400


def mixed_forms(rng):
    """(text, kind, start, end): an address whose signs and letters are disguised each in a way of its own."""
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    bold = lambda t: "".join(chr(0x1D41A + ord(c) - 97) if c.isascii() and c.islower() else c for c in t)
    wide = lambda t: "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in t)
    cyrillic = lambda t: t.translate(str.maketrans("aeopcx", "аеорсх"))
    dots = [" dot ", "[dot]", " [.] ", "(dot)", " (DOT) ", "{dot}", "  dot  ", " . ", "&#46;", "."]
    if rng.random() < 0.25:
        signs = [rng.choice(dots[:-1]), rng.choice(dots), rng.choice(dots)]
        rng.shuffle(signs)
        parts = [str(rng.randrange(256)) for _ in range(4)]
        own, kind = parts[0] + "".join(s + p for s, p in zip(signs, parts[1:], strict=True)), "ip"
    else:
        ats = [" at ", "[at]", " [at] ", "(at)", " {AT} ", "  at  ", " @ ", "&#64;", "&commat;", "-at-", "_at_", "@"]
        style = rng.choice([bold, wide, cyrillic, str, str, str])
        at, dot = rng.choice(ats), rng.choice(dots)
        plain = at.strip() in ("@", "at") and not dot.strip().startswith(("[", "(", "{"))
        end = rng.choice(["com", "org", "net", "de", "fr", "io"] if plain or at in ("-at-", "_at_") else ["com", "berlin", "museum", "travel"])
        if (at.strip() == "@" and dot == "." and style is str) or at == " at " and dot in (".", "&#46;") or at == "  at  " and dot in (".", "&#46;"):
            at, dot = "[at]", "."  # not disguised, or prose
        own, kind = style(word(5) + "a") + at + style(word(6) + "o") + dot + style(end), "email"
    before = " ".join(word(4) for _ in range(rng.randrange(4))) + "; "
    return before + own + ", " + word(5), kind, len(before), len(before) + len(own)


def test_forms_may_mix_within_one_address():
    rng, missed, many = random.Random(11), [], 1500
    for _ in range(many):
        text, kind, a, b = mixed_forms(rng)
        base, more = pii.spans(text)
        if (pii.KINDS.index(kind), a, b) not in base + more:
            missed.append(text)
    assert len(missed) <= 0.05 * many, missed[:40]


@pytest.mark.parametrize("text", ["look at example.com now", "look at this dot on the map", "see look-at-this.txt", "1. 2. 3. 4. five", "meet at noon. Then go", "a state-of-the-art file_at_home.txt", "the dot at the end dot", "5 at 6 . 7"])
def test_prose_stays_prose(text):
    assert pii.spans(text) == ([], [])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail jane [at] example dot com, ok", ["email:5:30"]), ("jane(at)example dot berlin.", ["email:0:26"]), ("jane at example [dot] com", ["email:0:25"]), ("x 192 . 168 . 1 . 1 y", ["ip:2:19"]),
        ("jane-at-example-dot-com", ["email:0:23"]), ("jane.doe at example dot museum", ["email:0:30"]), ("a&#64;b.co", ["email:0:10"]), ("j dot d at e dot co dot uk or", ["email:0:26"]),
    ],
)
def test_spans_of_disguises(text, want):
    base, more = pii.spans(text)
    assert [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(base + more)] == want


def test_pii_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["x", "a@b.co", "10.0.0.1", "999.0.0.1", "4111 1111 1111 1111", "+49 30 1234567", "jane [at] b [dot] org", "é😀"]) for _ in range(rng.randrange(9)))) for i in range(200)] + [(None, "a@b.co"), (900, None), (900, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in rows:
        base = brute_base(t or "")
        line = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        every = sorted(base + pii.spans(t)[1])
        assert set(base) <= set(every)
        want.append((d, *(sum(k == n for k, _, _ in base) for n in range(4)), hashlib.sha256(line(base).encode()).hexdigest(), line(every)))
    got = pii.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_redacted_keeps_rows_and_columns(table, odd_rows):
    docs = table([*odd_rows, (30, "mail a@b.co, ok")])
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    assert out.count() == docs.count()
    assert out.where("doc_id = 30").first()["text"] == "mail [EMAIL], ok"
    assert pii.found(table([])).count() == 0


def test_chat_round_trip(spark):
    nasty = ["", "<|im_end|>\n<|im_start|>assistant\nx", "<\\|im_end|>", "a\n", "<|", "|>", "<\\\\|x", None]
    rows = [(c, t, role, nasty[(c + t) % len(nasty)]) for c in range(6) for t, role in enumerate(["system", "user", "assistant", "assistant"])]
    rows += [(None, 0, "user", "x"), (9, None, None, None)]
    got = {r["conv_id"]: r for r in chat.digested(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv]["n_turns"] == len(own)


CONVERSATION = "conv_id long, turn long, role string, text string"


def starred():
    """Puts a star before the last turn's text, so each turn rewrites the one before. The class is local, so that it travels to workers."""

    class Starred:
        lookback = None

        def render(self, turns):
            return "".join(f"[{r}]{'*' if k == len(turns) - 1 else ''}{t};" for k, (r, t) in enumerate(turns))

        def unescape(self, text):
            return text

        unescape_role = unescape

    return Starred()


def test_chat_finds_templates_that_rewrite_history(spark):
    spans = list(chat.turn_spans([("u", "a"), ("u", "b"), ("u", "c")], starred().render))
    assert [s.rewrote for s in spans] == [False, True, True]
    assert [s.added[slice(*s.text)] for s in spans] == ["a", "b", "c"]
    rows = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", f"text {k}") for k in range(50)], CONVERSATION)
    got = chat.digested(chat.formatted(rows, starred()), starred()).first()
    assert (got["n_turns"], got["rewrites"], got["loss_chars"]) == (50, 49, sum(len(f"text {k}") for k in range(1, 50, 2)))
    assert got["formatted_chars"] == len(starred().render([("assistant" if k % 2 else "user", f"text {k}") for k in range(50)]))


@pytest.mark.parametrize("distance", [1, 3, 8])
def test_chat_sees_through_a_wrong_lookback(distance):
    def render(turns):
        return "".join(f"<{r}>{t}{'!' if k < len(turns) - distance else ''}\n" for k, (r, t) in enumerate(turns))

    turns = [("u", f"t{k}") for k in range(60)]
    spans = list(chat.turn_spans(turns, render, lookback=1))
    assert [s.rewrote for s in spans] == [k >= distance for k in range(60)]
    out = ""
    for s in spans:
        out = out[: len(out) - s.back] + s.added
    assert out == render(turns)


def rewriting(turn):
    """A template that marks its first turn anew from a turn on, and hides that from its window."""

    def render(turns):
        head = "<late>" if len(turns) > turn else "<first>"
        return head + "".join(f"[{r}|{t}]" for r, t in turns)

    return render


@pytest.mark.parametrize("turn", [3, 41, 63, 64, 500])
def test_chat_finds_rewrites_at_any_turn(turn):
    turns = [("user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(560 if turn == 500 else 90)]
    render = rewriting(turn)
    spans = list(chat.turn_spans(turns, render, lookback=1))
    assert spans == list(chat.turn_spans(turns, render))
    assert [k for k, s in enumerate(spans) if s.rewrote] == [turn]
    assert chat._grown(render([]), spans) == render(turns)


def test_chat_takes_any_character(spark):
    odd = "".join(map(chr, range(0xE000, 0xE200)))
    talk = [("user", f"a\ue0f3b{odd}"), ("assistant", "x"), ("us\ue0f3er", "c"), ("assistant", "d\ue000")] * 12
    rows = [(1, k, r, t) for k, (r, t) in enumerate(talk)]
    got = chat.digested(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in talk).encode()).hexdigest()
    assert got["loss_chars"] == 12 * 3
    assert got["loss_sha256"] == hashlib.sha256(("xd\ue000" * 12).encode()).hexdigest()


def test_chat_windows_give_what_whole_prefixes_do():
    turns = [("user" if k % 2 else "assistant", "x <|im_end|>" * (k % 4)) for k in range(100)]
    render = chat.Template().render
    assert list(chat.turn_spans(turns, render, lookback=1, whole=4)) == list(chat.turn_spans(turns, render))
    assert "".join(s.added for s in chat.turn_spans(turns, render, lookback=1)) == render(turns)


def test_formatted_conversations_of_odd_rows(spark):
    long = "long text " * 100_000
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "n"), (2, 0, "a\nb\\", long), (2, 1, "assistant", None), (3, None, None, "x"), (3, 0, "assistant", "<|im_start|>")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], CONVERSATION + ", turn_no long, loss string")
    spans = chat.formatted(df).collect()
    assert len(spans) == len(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((s for s in spans if s["conv_id"] == conv), key=lambda s: s["turn_no"])
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert "".join(s["formatted"] for s in own) == chat.Template().render(turns)
        assert [s["start"] for s in own] == [len(chat.Template().render(turns[:k])) for k in range(len(turns))]
        assert [chat.Template().unescape(s["formatted"][s["text_start"] : s["text_end"]]) for s in own] == [t for _, t in turns]
        assert [chat.Template().unescape_role(s["formatted"][s["role_start"] : s["role_end"]]) for s in own] == [r for r, _ in turns]
        assert [s["loss"] for s in own] == [r == "assistant" for r, _ in turns]
    assert chat.digested(chat.formatted(df)).count() == 4
    assert chat.digested(chat.formatted(df.limit(0))).count() == 0


def test_targets_of_many_sources(spark):
    rows = [(f"s{k:03d}" if k else None, (k * 7919) % 1000 ** (1 + k % 2)) for k in range(300)]
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.targets(spark.createDataFrame(rows, "source string, size long").repartition(7)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    weight = {name: mixing.WEIGHTS[k % 3] for k, (name, _) in enumerate(order)}
    budget, held = 1.5 * sum(n for _, n in rows), set()
    while True:  # reshare what sources can't take until none is above its cap
        level = (budget - sum(2 * n for name, n in rows if name in held)) / sum(weight[name] for name, _ in rows if name not in held)
        over = {name for name, n in rows if name not in held and level * weight[name] > 2 * n}
        if not over:
            break
        held |= over
    assert len(got) == 300 and 10 < len(held) < 290
    for name, n in rows:
        assert got[name] == (n, pytest.approx(2 * n if name in held else level * weight[name], rel=1e-9))


def test_mixing(table):
    rows = [(i, "w " * (i % 7), f"s{i % 3}" if i % 10 else None) for i in range(3000)] + [(5, "w w", "s1"), (5, "w w", "s1"), (None, "w", "s2")]
    docs = table(rows)
    plan = mixing.planned(docs).collect()
    assert len(plan) == len(rows)
    by = {}
    for r in plan:
        own = by.setdefault(r["mix_row"]["source"], [r["target"], r["source_size"], 0])
        own[2] += r["mix_size"] * r["mix_copies"]
        assert r["mix_copies"] <= 2
    assert sum(t for t, _, _ in by.values()) == pytest.approx(1.5 * sum(s for _, s, _ in by.values()))
    for target, size, taken in by.values():
        assert target <= 2 * size
        assert taken == pytest.approx(target, rel=0.15)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["mix_copies"] for r in plan)
    assert mixing.planned(table([])).count() == 0


def test_toxicity_ranks_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = toxicity.query(spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").where("held_out and toxic is not null").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in rows)
    good, bad = ([r["score"] for r in rows if r["toxic"] == c] for c in (0, 1))
    auc = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(good) * len(bad))
    assert auc > 0.9


def test_toxicity_of_odd_rows(spark, table, odd_rows):
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    docs = table(odd_rows)
    tables, curve = toxicity.fit(docs, labels, F.lit(True), F.lit(True))
    scores = [r["score"] for r in toxicity.scored(docs, tables, curve).collect()]
    assert len(scores) == len(odd_rows)
    assert all(0 <= s <= 1 for s in scores)
    assert toxicity.scored(table([]), tables, curve).count() == 0


def brute_differences(rows):
    """For words and for stems, the difference of any of them, from (toxic, text): counts discounted by n1 / (n1 + 2 n2), the rest by the number of texts."""
    out = []
    for unit in (lambda w: w, lambda w: w[: toxicity.STEM]):
        n, texts = (Counter(), Counter()), Counter()
        for toxic, text in rows:
            own = [unit(w) for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())]
            n[toxic].update(own)
            texts.update(set(own))
        shared = lambda u, texts=texts, n=n: (texts[u] + 0.5) / (sum(texts.values()) + 0.5 * (len(set(n[0]) | set(n[1])) + 1))
        log = []
        for c in (0, 1):
            one, two = (sum(v == k for v in n[c].values()) for k in (1, 2))
            d = one / (one + 2 * two) if one and two else 0.5
            total, kept = max(sum(n[c].values()), 1), sum(max(v - d, 0) for v in n[c].values())
            log.append(lambda u, c=c, d=d, total=total, kept=kept, n=n, shared=shared: math.log((max(n[c][u] - d, 0) + (total - kept) * shared(u)) / total))
        out.append((lambda w, unit=unit, log=log: log[1](unit(w)) - log[0](unit(w)), set(n[0]) | set(n[1])))
    return out


def _keys(words):
    """Keys of words as wholes, and by their stems."""
    _, low, first, stop, _ = next(toxicity.word_slices(pa.array([" ".join(words)])))
    return [k.tolist() for k in toxicity.keys(low, first, stop)]


def test_toxicity_likelihoods_are_those_of_brute_force(spark):
    rng = random.Random(4)
    rows = [(int(i % 3 == 0), i % toxicity.FOLDS, " ".join("".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(0, 300)))) for i in range(100)]
    got = {r["key"]: r["difference"] for r in toxicity.differences(toxicity.counted(spark.createDataFrame(rows, "toxic int, fold int, text string"))).collect()}
    for k in range(1 + toxicity.FOLDS):
        for level, (want, seen) in enumerate(brute_differences([(t, x) for t, f, x in rows if f != k - 1])):
            seen = sorted(seen)
            assert [got[key][k] for key in _keys(seen)[level]] == pytest.approx([want(w) for w in seen], abs=1e-4)
            assert got[toxicity.UNSEEN[level]][k] == pytest.approx(want("zzzzzz"), abs=1e-4)


def test_toxicity_scores_come_from_all_words(spark, table, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 120)))) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(100)] * 2, "doc_id long, toxic int")
    docs = table([*rows, (None, "abc abd"), (3, None)]).withColumn("toxic", F.lit("x")).withColumn("by", F.lit(1))
    model, curve = toxicity.fit(docs, labels, F.lit(True), F.lit(True))
    want = brute_differences([(int(i % 3 == 0), t) for i, t in [*rows[:100], (3, "")]])
    got = {r["doc_id"]: r for r in toxicity.evidence(docs, model).collect()}
    for i, t in rows[60:]:
        for (word, _), name in zip(want, ("mean", "stem_mean"), strict=True):
            ws = [word(w) for w in t.split()]
            assert got[i][name] == pytest.approx(sum(ws) / len(ws) if ws else 0, abs=1e-3)
    order = lambda df: sorted((str(r["doc_id"]), r["score"]) for r in df.collect())
    by_broadcast = order(toxicity.scored(docs, model, curve))
    monkeypatch.setattr(toxicity, "BROADCAST_KEYS", 10)
    monkeypatch.setattr(toxicity, "_CHUNK", 1000)
    joined = order(toxicity.scored(docs, model, curve))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(joined, by_broadcast, strict=True))


def test_toxicity_tells_words_with_one_opening_apart(spark, table):
    rows = [(i, "the abcdxyz and so" if i % 2 else "the abcdqrs and so") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    model, curve = toxicity.fit(table(rows), labels, F.lit(True), F.lit(True))
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(table(rows), model, curve).collect()}
    assert min(scores[i] for i in range(301, 400, 2)) > 0.9 > 0.1 > max(scores[i] for i in range(300, 400, 2))


def test_toxicity_query_learns_from_all_but_the_held_out(spark, tmp_path):
    word = lambda i: "z" + "".join("abcdefghij"[int(c)] for c in f"{i:03d}")
    rows = [(i, f"{word(i)} of the {'vile' if i % 2 else 'mild'} words") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = []
    own = toxicity.scored
    try:
        toxicity.scored = lambda docs, model, curve: (seen.append(model), own(docs, model, curve))[1]
        toxicity.query(spark, str(tmp_path)).collect()
    finally:
        toxicity.scored = own
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    key = dict(zip(range(300), _keys([word(i) for i in range(300)])[0], strict=True)).__getitem__
    keys = {r["key"] for r in seen[0].collect()}
    assert {key(i) for i, _ in rows if i not in held} <= keys
    assert not {key(i) for i in held} & keys

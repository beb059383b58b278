"""Token counts, spelling variants and conversation repair against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from weftline.llm import conversation_repair, spelling, token_count

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = ", __id string, __text string, conv string, said string, first string, c string, h string, n long, word string, run string, id string, k1 string"
SPARE = (None,) * 12


def library_counts(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(x.ids) for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def machine():
    return token_count.Machine(token_count.production(), token_count.kinds_of_characters())


def mixed(rng, n):
    parts = ["'s", "'S", "'r", "'re", "'v", "'ve", "'l", "'ll", "'", "''", "a", "s", "e", "1", "²", " ", "  ", "\n", "\t", "　", " ", "!", "..", "é", "漢字", "🙂", "the", "ing", "<|endoftext|>", "<|", "\x00", "\r\n", "----", "aaaa", "ﷺ", "é"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_counts_equal_the_library(machine):
    rng = random.Random(3)
    texts = [mixed(rng, rng.randint(0, 40)) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(2000)]
    assert machine.count(texts).tolist() == library_counts(texts)


def test_counts_of_long_texts_and_small_pieces(machine, monkeypatch):
    rng = random.Random(4)
    long = ["a" * 50_000, " " * 3000 + "x", "".join(rng.choice("abé1' ") for _ in range(60_000)), mixed(rng, 20_000), "\n" * 500]
    want = library_counts(long)
    assert machine.count(long).tolist() == want
    monkeypatch.setattr(token_count, "PIECE", 50)
    monkeypatch.setattr(token_count, "CHUNK", 7)
    assert machine.count(long).tolist() == want
    for name in ("MOST_STATES", "MOST_WORDS", "MOST_PAIRS"):
        monkeypatch.setattr(token_count, name, 20)  # compiled anew all the time
    assert machine.count(long).tolist() == want


def test_state_maps_compose(machine):
    """The scanned maps give the states that a walk through all characters gives."""
    rng = random.Random(5)
    lanes = token_count.np.array([[rng.randrange(len(token_count.KINDS)) for _ in range(40)] for _ in range(9)], token_count.np.uint8)
    got = machine.words.scan(machine.words.maps(lanes))
    for first in range(len(token_count.STATES)):
        state = token_count.STATES[first]
        for lane in range(40):
            for kind in lanes[:, lane]:
                state = token_count.step(state, token_count.KINDS[kind])[0]
            assert token_count.STATES[got[first, lane]] == state


def test_token_counts_of_a_table(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "x", "<|endoftext|>", "it's <|endoftext|> 'round", "word " * 1200, *(mixed(rng, 30) for _ in range(40)), "same", "same"]
    rows = [(None if k == 3 else k % 45, t, *SPARE) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string" + CLASH).repartition(3)
    want = sorted((str(r[0]), len((r[1] or "").encode()), n, n > 1024) for r, n in zip(rows, library_counts(texts), strict=True))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.token_counts(docs, token_count.production()).collect()) == want
    assert token_count.token_counts(docs.limit(0), token_count.production()).count() == 0


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    form, count = {}, {}
    for w in n:
        beside = [v for v in n if near(w, v)]
        count[w] = len(beside)
        best = min(beside, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], count[w], n.get(form[w])) for w in n}


def test_spelling_variants(spark):
    rng = random.Random(7)
    base = ["letter", "Lettre", "stone", "école", "ÉCOLE", "aaaaa", "banana", "naïve", "q" * 3000, "straße"]
    words = []
    for w in base:
        for k in range(12):
            i = rng.randrange(len(w))
            v = rng.choice([w, w, w[:i] + w[i + 1 :], w[:i] + rng.choice("abéz") + w[i:], w[:i] + rng.choice("abéz") + w[i + 1 :]])
            words += [v] * rng.choice([1, 3, 3, 4, 7, 16, 33])
    words += ["chain"] * 4 + ["chains"] * 14 + ["chainsa"] * 40 + ["chainsab"] * 110
    words += [f"hot{c}stone" for c in "abcdefghijklmnopqrstuvwxyzàáâ" for _ in range(3)]
    rng.shuffle(words)
    rows = [(k, rng.choice([" ", "_", "-", "\n", "7"]).join(words[k * 40 : k * 40 + 40])) for k in range(len(words) // 40 + 1)]
    rows += [(None, None), (5, ""), (None, "banana stone"), (5, "漢字 12 x"), (6, rows[6][1]), (6, rows[6][1])]
    docs = spark.createDataFrame([(*r, *SPARE) for r in rows], "doc_id long, text string" + CLASH).repartition(4)
    got = {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in spelling.variants(docs).collect()}
    want = plain_variants(rows)
    assert got == want and sum(v[0] is not None for v in want.values()) > 20
    assert want["chain"][1] == "chainsab"
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(docs.filter("text = ''")).count() == 0


def test_fingerprints_tell_all_places_apart():
    """Equal just where the strings are equal, for words in one block of any lengths."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abÿ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    first = spelling.np.r_[0, spelling.np.cumsum([len(w) for w in words])]
    codes = spelling.np.frombuffer("".join(words).encode("latin-1"), spelling.np.uint8).astype(spelling.np.int64)
    whole, wild, less = spelling.Fingerprints().of(codes, first)
    seen = defaultdict(set)
    for k, w in enumerate(words):
        seen[tuple(whole[k])].add(w)
        for i in range(len(w)):
            seen[tuple(wild[first[k] + i])].add(w[:i] + "\x01" + w[i + 1 :])
            if len(w) > 1:
                seen[tuple(less[first[k] + i])].add(w[:i] + w[i + 1 :])
    assert all(len(x) == 1 for x in seen.values()) and len(seen) == len(set().union(*seen.values()))


WS = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """rows: (conv, turn, role, text), not yet damaged. Every way of editing is tried, place by place."""
    out, convs = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, turns in convs.items():
        turns.sort()
        seen, fault = set(), []
        for _, _, role, text in turns:
            body = text.strip(WS)
            fault.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        best = {}
        for i in range(len(turns), -1, -1):
            now = {}
            if i == len(turns):
                now = {"": (0, "", ()), "a": (0, "", ())}
            else:
                _, _, role, text = turns[i]
                for state in step:
                    ways = [(4, "D", state, ())]
                    if fault[i] in ("", "truncated"):
                        more = 3 * (fault[i] == "truncated")
                        if (after := step[state].get(role[:1])) is not None:
                            ways.append((more, "K", after, (f"{role}:{text}",)))
                        for name in ("user", "assistant"):
                            if (after := step[state].get(name[0])) is not None:
                                ways.append((3 + more, "R", after, (f"{name}:{text}",)))
                    now[state] = min((c + best[s][0], e + best[s][1], line + best[s][2]) for c, e, s, line in ways if s in best)
            for _ in range(3):
                for state in step:
                    for name in ("user", "assistant"):
                        if (after := step[state].get(name[0])) in now:
                            c, e, lines = now[after]
                            way = (c + 3, "I" + e, (f"{name}:", *lines))
                            now[state] = min(now.get(state, way), way)
            best = now
        known = [t for has, t, *_ in turns if has]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, lines = best[""]
        out[conv] = (gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversations():
    rng, rows = random.Random(9), []
    texts = ["Yes.", "Yes.", "no", "Why?", "", " \t", None, "so on. ", "end!\n", "x", "漢字。", "a.b"]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None]
    for conv in range(60):
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 5, None, -3]), rng.choice(roles), rng.choice(texts)))
    rows += [(100, t, rng.choice(roles[:5]), f"{rng.choice(texts)}{t % 9}.") for t in range(150)]  # a long one
    rows += [(101, 7, "user", "Same."), (102, None, None, None)] * 30  # repeated rows
    rows += [(None, t, ["user", "assistant"][t % 2], f"t{t}.") for t in range(6)]
    rows += [(200 + c, 0, "user", "Hi.") for c in range(60)]  # some lose their only turn
    return rows


@pytest.mark.parametrize("segment", [256, 3])
def test_conversation_repair(spark, monkeypatch, segment):
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    rows = conversations()
    df = spark.createDataFrame([(*r, *SPARE[2:]) for r in rows], "conv_id long, turn long, role string, text string" + CLASH.replace(", __id string, __text string", "")).repartition(5)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conversation_repair.repair(conversation_repair.damaged(df)).collect()}
    want = plain_repair(rows)
    assert got == want
    assert {e for w in want.values() for e in w[6]} == set("DIKR") and any(w[6] == "" for w in want.values())
    assert conversation_repair.repair(conversation_repair.damaged(df.limit(0))).count() == 0


def test_tables_of_segments_compose():
    """The costs of a row of turns are those of its segments' tables, put together from the end."""
    rng = random.Random(10)
    for _ in range(200):
        rows = [(rng.choice("suax"), rng.choice([0, 1, 1, 1, 2]), rng.randrange(4)) for _ in range(12)]
        owns, copies = [conversation_repair.own(*r) for r in rows], [r[1] for r in rows]
        cut = rng.randrange(13)
        whole = conversation_repair.price(owns, copies, conversation_repair.END)[0]
        after = conversation_repair.before(conversation_repair.table(owns[cut:], copies[cut:]), conversation_repair.END)
        assert conversation_repair.before(conversation_repair.table(owns[:cut], copies[:cut]), after) == whole

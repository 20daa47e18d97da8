"""Token files, tokenizer alignment and the conversation trie against brute force."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from paneltide.llm import alignment, chunks, prefix_trie, queries, token_files

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, ids string, at long, part int, file string, links string, _row long, n_tokens string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeéñ漢😀ſ") for _ in range(1 + rng.randrange(7))) + rng.choice(["", "", ".", ",", "!!", "***"]) for _ in range(300)]
    out = [None, "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "\ta", "a\t b", "a\tb c", "x  y", "x 　y", "▁x", "a ▁ b", "<0x0A>", "<s> a </s>",
           "<|endoftext|>", "x <|endoftext|> y", "it's 'tis we'll", "a᠎ b", "nul\0nul", "nul \0 nul", "é漢́ ½²", "\x1c a\x1f b", "á á", "x" * 5000, "1234567 89"]
    for _ in range(60):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  ", "\n\n", "\t", ""]) for _ in range(rng.randrange(60))))
    return out + out[:12] + [" ".join(rng.choice(words) for _ in range(20_000))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 7 % 1000, t, "x", 1, 2, "f", "l", 3, "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer
    plain, special = (Tokenizer.from_file(P.path("byte_bpe_50k.json")) for _ in range(2))
    plain.encode_special_tokens = True
    return plain, special, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_blocks_give_back_their_ids():
    rng = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 4096):
        for values in (rng.integers(0, 1 << 32, n), np.zeros(n), rng.integers(5, 9, n), np.r_[rng.integers(0, 3, n - 1), (1 << 32) - 1], np.minimum(rng.pareto(0.4, n) * 9, 50256)):
            ids = values.astype(np.uint32)
            assert (token_files.unblock(memoryview(token_files.block(ids))) == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(4096, 3, np.uint32)
    ids[::100] = 1 << 20
    assert len(token_files.block(ids)) < 10 + 41 * 5


def test_file_ranges_and_damage(tmp_path):
    ids = np.random.default_rng(1).integers(0, 50_000, 10_001).astype(np.uint32)
    where = token_files.filesystem(f"file://{tmp_path}")
    out = token_files.Writer(where[0].open_output_stream(f"{where[1]}/a", compression=None))
    for part in np.split(ids, [1, 1, 5000, 9999]):
        out.add(part)
    out.close()
    reader = token_files.Reader(where[0].open_input_file(f"{where[1]}/a"))
    for start, n in ((0, 0), (0, 1), (4095, 2), (4096, 4096), (0, 10_001), (10_000, 1)):
        assert (reader.read(start, n) == ids[start:start + n]).all()
    with pytest.raises(ValueError):
        reader.read(10_000, 2)
    (tmp_path / "b").write_bytes((tmp_path / "a").read_bytes()[:-3])
    with pytest.raises(ValueError):
        token_files.Reader(where[0].open_input_file(f"{where[1]}/b"))


def test_token_files(docs, tokenizers):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: r[0])
    want, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*tokenizers[1].encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_files.digests(docs)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_token_files_of_shared_and_missing_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (1, None), (None, "c"), (None, None), ((1 << 60) + 1, "d")] + [(5, "same")] * 50
    got = sorted(token_files.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert [r["doc_id"] for r in got] == [None] * 2 + [1] * 3 + [5] * 50 + [(1 << 60) + 1]
    assert token_files.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tables_of_chunks_stay_bounded(texts):
    made = []
    kept = chunks.Kept(lambda new: [made.extend(new) or c for c in new], limit=20)
    for text in texts * 2:
        if text:
            assert "".join(kept.of(text)) == text
            assert len(kept.new) <= 20 + 2 * len(set(kept.of(text)))  # a text's own chunks come on top
    assert made


def test_words_go_to_the_model_at_once(texts, tokenizers):
    encoder, through = token_files.Encoder(P.path("byte_bpe_50k.json")), []
    ids = encoder.ids
    encoder.ids = lambda text: through.append(text) or ids(text)
    text = "Words of\nplain letters" + "".join(f" {a}{b}word" for a in "abcdefgh" for b in "Tñorşt")
    assert encoder.plain and encoder.encode(text) == np.array(tokenizers[1].encode(text).ids, "<u4").tobytes()
    assert "".join(through) == "Words"  # what no cut stands before
    for one in [t for t in texts if t] + ["a's b'll 's", "\n's it", "x\nABC d1 e.f", "\n\nab"]:
        assert encoder.encode(one) == np.array(tokenizers[1].encode(one, add_special_tokens=False).ids, "<u4").tobytes()


def test_cuts_are_judged_by_their_parts():
    rng, uneven, seen = random.Random(4), re.compile(r"[ \n]\s|[^\S \n][ \n]|\s\Z"), set()
    for _ in range(5000):
        text = "".join(rng.choice(["a", "b", " ", "\n", "\t", "\u3000", "."] if rng.random() < 0.3 else ["a", "bc"]) for _ in range(1 + rng.randrange(9)))
        parts = [p for p in text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0") if p]
        assert all(map(chunks.cut_even, parts)) == (not uneven.search(text)), text
        seen.add(bool(uneven.search(text)))
    assert len(seen) == 2


def test_known_chunks_are_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return super().get(key)
    kept = chunks.Kept(lambda new: [c.upper() for c in new])
    kept.new = Counted()
    assert "".join(kept.of("one two one two three")) == "ONE TWO ONE TWO THREE" and Counted.asked == 5


def decoded(tokenizers):
    plain, _, pieces = tokenizers
    alphabet, names = alignment.byte_alphabet(), {i: t for t, i in plain.get_vocab().items()}

    def of_piece(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()

    return lambda i: bytes(alphabet[c] for c in names[i]), of_piece


def brute_alignment(rows, tokenizers):
    plain, _, pieces = tokenizers
    of_a, of_b = decoded(tokenizers)
    counts, found = collections.Counter(), []
    for doc_id, text in rows:
        one = (doc_id, 0, 0, 0, [], "")
        if text:
            a, b, raw = plain.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text), (" " + text).encode()
            bytes_a, bytes_b = list(map(of_a, a)), list(map(of_b, b))
            if b"".join(bytes_a) == raw == b"".join(bytes_b):
                own_a = [i for i, x in enumerate(bytes_a) for _ in x]
                own_b = [i for i, x in enumerate(bytes_b) for _ in x]
                pairs = list(dict.fromkeys(zip(own_a, own_b)))
                ends = sorted(set(np.cumsum(list(map(len, bytes_a))).tolist()) & set(np.cumsum(list(map(len, bytes_b))).tolist()))
                groups, at = [], 0
                for end in ends:
                    groups.append(",".join(str(a[i]) for i in dict.fromkeys(own_a[at:end])) + "|" + ",".join(str(b[i]) for i in dict.fromkeys(own_b[at:end])))
                    at = end
                links = [(a[i], b[j]) for i, j in pairs]
                counts.update(links)
                one = (doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
        found.append(one)
    top = collections.Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted((d, a, b, g, len(li), sum(counts[p] == top[p[1]] for p in li), sum(counts[p] for p in li), h) for d, a, b, g, li, h in found)


def test_line_ends_are_aligned_with_the_other_chunks():
    own, alone = alignment.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")), []
    line = own.line
    own.line = lambda chunk: alone.append(chunk) or line(chunk)
    new = [" one", "\nTwo", " three", "\nfo\u00fcr", "\n\u6f22x"]
    assert own.make(new) == [own.whole("one"), *(line(c) if c[0] == "\n" else own.whole(c[1:]) for c in new[1:])] and not alone
    assert own.make(["\nTwo"]) == [line("\nTwo")] and alone == ["\nTwo"]  # no chunk to stand behind


def test_alignment_both_ways(docs, tokenizers):
    want = brute_alignment([(r["doc_id"], r["text"]) for r in docs.collect()], tokenizers)
    assert any(w[1] == 0 for w in want) and any(w[1] > 1000 for w in want)
    for limit in (alignment.MAX_PAIRS, 3):
        got = alignment.scored(docs, max_pairs=limit)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, got.collect())) == want


def test_groups_of_an_alignment(spark, tokenizers):
    docs = spark.createDataFrame([(1, "né漢 word"), (2, None), (None, "▁")], "doc_id long, text string")
    got = {r["doc_id"]: r["groups"] for r in alignment.groups(docs).collect()}
    of_a, of_b = decoded(tokenizers)
    assert b"".join(of_a(i) for g in got[1] for i in g["a"]) == " né漢 word".encode() == b"".join(of_b(i) for g in got[1] for i in g["b"])
    assert all(b"".join(map(of_a, g["a"])) == b"".join(map(of_b, g["b"])) for g in got[1])
    assert got[2] == [] and got[None] == []
    assert alignment.scored(docs.limit(0)).collect() == []


def brute_trie(rows, rebuilt=True):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    convs = {c: [x[2:] for x in sorted(own)] for c, own in convs.items()}
    if rebuilt:
        heads = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
        convs = {c: convs.get(c - c % 100, [])[:heads[c]] + own[heads[c]:] for c, own in convs.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    children, leaves, saved = collections.Counter(k[:-1] for k in members if k), collections.Counter(), collections.Counter()
    for k, own in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(own) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += not children[k]
    return sorted(((own[0], len(k), members[k[:-1]][0] if k else None, len(own), children[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, own in members.items()), key=str)


TURNS = "conv_id long, turn long, role string, text string, path string, key string, kind int, ids string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "p", "k", 1, "i") for r in rows], TURNS)


def test_trie_of_rebuilt_conversations(spark):
    rng = random.Random(5)
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", None, ""]), rng.choice(["a", "é", "漢字", None, "", "b" * 50]))
            for c in [*range(98, 205), 300, 1, 407] for t in range(rng.randrange(1, 9))]
    rows += [(500 + c, t, "user", "common") for c in range(60) for t in range(4)]  # copies
    rows += [(700, t, "user", f"turn {t}") for t in range(150)] + [(None, 0, "user", "x"), (1, 1, "a", "a"), (1, 1, "a", "a"), (1, 1, "b", "a")]
    got = prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.paths(turns_of(spark, rows))))
    assert got.columns == prefix_trie.COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_whatever_the_shards(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(c, t, "u", rng.choice("ab")) for c in range(80) for t in range(rng.randrange(7))] + [(100 + c, 0, "u", "hot") for c in range(200)]
    want = brute_trie(rows, rebuilt=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", 3)
    try:
        for shards in (1, 3, 60):
            spark.conf.set("spark.sql.shuffle.partitions", shards)
            assert sorted(map(tuple, prefix_trie.of_turns(turns_of(spark, rows)).collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert prefix_trie.of_turns(turns_of(spark, rows).limit(0)).collect() == []


def test_turnless_conversations_are_members_of_the_root(spark):
    n = next(c for c in range(1001, 1099) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(n, 0, "u", "own turn, replaced by none")]
    got = prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.paths(turns_of(spark, rows)))).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows) and len(got) == 1 and got[0]["n_leaves"] == 1


def test_findclose_against_a_stack():
    rng = random.Random(2)
    for n in (1, 5, 64, 65, 700, 5000):
        opens, left, depth = [], n, 0
        while left or depth:
            if left and (depth == 0 or rng.random() < 0.5 + 0.4 * (n == 5000)):
                opens.append(True)
                left, depth = left - 1, depth + 1
            else:
                opens.append(False)
                depth -= 1
        opens = np.array([True, *opens, False])
        stack, want = [], {}
        for i, o in enumerate(opens.tolist()):
            if o:
                stack.append(i)
            else:
                want[stack.pop()] = i
        at = np.flatnonzero(opens)
        assert prefix_trie.Excess(opens).findclose(at).tolist() == [want[i] for i in at.tolist()]


def test_trie_query_agrees_with_its_sql(spark):
    import duckdb
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    rel = con.execute(queries.SQL["op12_prefix_trie"])
    names = [d[0] for d in rel.description]
    want = sorted(map(tuple, rel.fetchall()), key=str)
    assert sorted(map(tuple, queries.QUERIES["op12_prefix_trie"](spark, folder).select(*names).collect()), key=str) == want


def test_stages_keep_columns_of_any_name(spark):
    from paneltide.llm import mixing, quality
    rng = random.Random(1)
    text = " ".join(" ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(9)) + "." for _ in range(12))
    more = ["_hash", "_clean", "_source", "_full", "_passes", "_target", "_source_size", "_size", "_times", "_row"]
    rows = [(i, f"{text} It has the mark {i}.", f"s{i % 2}", *[f"{c}{i}" for c in more]) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *more])
    for out in (quality.cleaned(docs), mixing.mixed(docs)):
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in more)

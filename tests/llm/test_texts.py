"""Quality rules, secret scans and token counts against plain Python."""

import hashlib
import math
import re
import time
from collections import Counter

import pytest

from corpusloom.llm.quality_rules import COMMON, REFERENCES, fit_references, quality_rules
from corpusloom.llm.secrets import all_spans, base_spans, redacted, scan
from corpusloom.llm.token_counts import default_model, token_counts
from corpusloom.session import Scratch
from tests.llm.helpers import ODD, parquet, table, words


def base_counts(text):
    w, text = words(text), text or ""
    grams = Counter(zip(w, w[1:], w[2:]))
    again = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))


REPEATED = [(20, "same line here\n" * 5 + "other # * $ % & | < >"), (21, "a b c " * 30), (22, "a b c d a b c")]


def test_quality_rules_count_as_plain_python_does(spark):
    docs = table(spark, ODD + REPEATED).select("doc_id", "text", "lang").unionByName(parquet(spark, "documents").select("doc_id", "text", "lang"))
    found = quality_rules(spark, docs, Scratch(spark)).collect()
    got = sorted(str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in found)
    assert got == sorted(str((r["doc_id"], *base_counts(r["text"]))) for r in docs.collect())
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_quality_rules_reject_junk_and_keep_prose(spark):
    prose = parquet(spark, "documents", "0.01").where("n_chars > 1000").select("doc_id", "text", "lang")
    junk = table(spark, [(10**6, " ".join(f"%{k}#|{k * 7919}>" for k in range(400)), "en")]).select("doc_id", "text", "lang")
    found = {r["doc_id"]: r for r in quality_rules(spark, prose.unionByName(junk), Scratch(spark)).collect()}
    assert not found[10**6]["kept"] and not found[10**6]["base_failed"]
    good = parquet(spark, "labels", "0.01").where("quality = 1").join(prose, "doc_id").select("doc_id").collect()
    kept = [found[r["doc_id"]]["kept"] for r in good if not found[r["doc_id"]]["base_failed"]]
    assert sum(kept) >= 0.95 * len(kept)


def junk_text(seed, n):
    return " ".join(f"%{k}#|{(k + seed) * 7919}>" for k in range(n))


def prose_and_junk(spark, junk):
    """Share kept of each language's good prose, and the junk ids kept."""
    prose = parquet(spark, "documents", "0.01").join(parquet(spark, "labels", "0.01").where("quality = 1"), "doc_id").where("n_chars > 1000").select("doc_id", "text", "lang")
    found = quality_rules(spark, prose.unionByName(table(spark, junk).select("doc_id", "text", "lang")), Scratch(spark)).where("not base_failed")
    kept = {r["doc_id"]: r["kept"] for r in found.collect()}
    of = {}
    for r in prose.select("doc_id", "lang").collect():
        of.setdefault(r["lang"], []).append(kept.get(r["doc_id"], True))
    return {k: sum(v) / len(v) for k, v in of.items()}, [i for i, _, _ in junk if kept[i]]


def test_quality_rules_hold_with_a_third_of_junk_or_one_huge_junk_text(spark):
    prose = parquet(spark, "documents", "0.01").join(parquet(spark, "labels", "0.01").where("quality = 1"), "doc_id").where("n_chars > 1000")
    sizes = {r["lang"]: r["count"] for r in prose.groupBy("lang").count().collect()}
    third = [(10**6 + 10**4 * j + k, junk_text(k, 300), lang) for j, (lang, n) in enumerate(sorted(sizes.items())) for k in range(n // 2)]
    huge = [(10**6, junk_text(0, 300_000), "en")]
    for junk in (third, huge):
        shares, wrong = prose_and_junk(spark, junk)
        assert not wrong
        assert min(shares.values()) >= 0.95, shares


def test_quality_rules_judge_each_language_by_its_own_reference(spark):
    ja = [(k, " ".join("日本語の文章です" * 3 for _ in range(60)) + " " + " ".join(chr(0x4E00 + k + i) for i in range(50)), "ja") for k in range(30)]
    ru = [(100 + k, " ".join("привет мир как дела" for _ in range(5)) + " " + " ".join(f"слово{'абвгд'[i % 5]}{'еёжзи'[k % 5]}{'йклмн'[i // 5 % 5]}, Дом" for i in range(50)), "ru") for k in range(90)]
    found = {r["doc_id"]: r["char_distance"] for r in quality_rules(spark, table(spark, ja + ru).select("doc_id", "text", "lang"), Scratch(spark), max_repeat_percent=100).collect()}
    assert max(found.values()) < 0.05


def sentences(lang, n, letters, at=0):
    """n texts of 60 different words out of letters."""
    return [(at + k, " ".join(letters[(k + i) % len(letters)] + letters[i % 7] + letters[i // 7 % 9] for i in range(60)), lang) for k in range(n)]


def test_quality_references_fitted_apart_judge_a_text_alike_in_every_table(spark):
    prose = parquet(spark, "documents", "0.01").where("n_chars > 1000").select("doc_id", "text", "lang")
    refs = fit_references(spark, prose, Scratch(spark), "v1")
    assert {r["version"] for r in refs.collect()} == {"v1"} and refs.schema.simpleString() == spark.createDataFrame([], REFERENCES).schema.simpleString()
    junk = table(spark, [(10**6 + k, junk_text(k, 300), "en") for k in range(60)]).select("doc_id", "text", "lang")
    few = prose.where("doc_id % 20 = 0")
    alone = {r["doc_id"]: r["kept"] for r in quality_rules(spark, few, Scratch(spark), references=refs).collect()}
    among = {r["doc_id"]: r["kept"] for r in quality_rules(spark, few.unionByName(junk), Scratch(spark), references=refs).collect()}
    own = {r["doc_id"]: r["kept"] for r in quality_rules(spark, prose, Scratch(spark)).collect()}
    # junk in most rows of a language is found out by references from elsewhere
    assert len(alone) > 20 and alone == {i: among[i] for i in alone} == {i: own[i] for i in alone}
    assert not any(kept for i, kept in among.items() if i >= 10**6)


def test_quality_references_lean_on_the_shared_one_without_a_step(spark):
    def distance(n):
        rows = sentences("xx", n, "абвгдежзик") + sentences("yy", 60, "abcdefghij", 1_000)
        found = quality_rules(spark, table(spark, rows).select("doc_id", "text", "lang"), Scratch(spark), max_repeat_percent=100, trim=1.0)
        return found.where("doc_id = 0").first()["char_distance"]

    at = [distance(n) for n in (1, 5, 19, 20, 21, 60)]
    assert at == sorted(at, reverse=True) and at[0] > 2 * at[-1]
    assert max(at[2] - at[3], at[3] - at[4]) < 0.1 * at[3]


def test_quality_references_of_another_form_are_refused_and_missing_ones_shared(spark):
    docs = table(spark, sentences("zz", 2, "abcdefghij")).select("doc_id", "text", "lang")
    none = fit_references(spark, docs.limit(0), Scratch(spark), "v0")
    assert none.count() == 0
    assert [r["char_distance"] for r in quality_rules(spark, docs, Scratch(spark), references=none).collect()] == [0.0, 0.0]
    refs = fit_references(spark, table(spark, sentences("xx", 30, "абвгдежзик")), Scratch(spark), "v1", max_repeat_percent=100)
    assert all(r["char_distance"] > 0.5 for r in quality_rules(spark, docs, Scratch(spark), references=refs).collect())
    short = spark.createDataFrame([("v1", "xx", 1, [1.0], [1.0])], REFERENCES)
    for wrong in (short, refs.unionByName(refs), refs.limit(1).unionByName(refs.selectExpr("'v2' version", "'yy' lang", "n_rows", "chars", "words"))):
        with pytest.raises(ValueError):
            quality_rules(spark, docs, Scratch(spark), references=wrong)


def char_class(c):
    sets = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", "\n")
    return next((k for k, s in enumerate(sets) if c in s), 6 if c in "#*$%&|<>" else 5 if c.isascii() else 7)


def spread(counts):
    total = sum(counts.values())
    return {k: v / total for k, v in counts.items()} if total else {}


def divergence(p, q):
    """Jensen-Shannon distance of two shares, by its definition."""
    part = lambda a, b: sum(x * math.log2(2 * x / (x + b.get(k, 0))) for k, x in a.items() if x > 0)
    return math.sqrt(max(0, (part(p, q) + part(q, p)) / 2)) if p else 0.0


def verdicts(rows):
    """The rule's distances by plain Python: rows (lang, text) -> per row (base failed, summed relative distance)."""
    fold = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    facts = []
    for lang, text in rows:
        lang = lang or ""
        known = COMMON.get(lang, "").split()
        w = words(text)
        folded = Counter(x if x in known else None for x in (y.translate(fold) for y in w))
        n_repeat = base_counts(text)[-1]
        facts.append((lang, len(w), len(w) < 50 or 2 * n_repeat > len(w), spread(Counter(map(char_class, text or ""))), spread(folded)))
    passing = [f for f in facts if not f[2]]
    sizes = Counter(f[0] for f in passing)
    refs, shared = {}, {}
    # the reference of languages without a list first; theirs lean on it
    for name in ["*", *sizes]:
        group = [f for f in passing if f[0] == name or name == "*" and f[0] not in COMMON]
        if not group:
            continue
        lean = 0 if name in COMMON or name == "*" else 1 / (1 + (sizes[name] / 5) ** 2)
        mix = lambda own, at: {k: (1 - lean) * own.get(k, 0) + lean * shared[at].get(k, 0) for k in range(8)} if lean else own
        middle = lambda xs: sorted(round(4096 * x) for x in xs)[(len(xs) + 1) // 2 - 1] / 4096
        chars = mix({k: middle([f[3].get(k, 0) for f in group]) for k in range(8)}, "middle")
        rest = middle([f[4].get(None, 0) for f in group])
        near = []
        for f in group:
            good = divergence(f[3], spread(chars)) <= 0.2
            if name in COMMON:
                other = f[4].get(None, 0)
                good = good and divergence({0: 1 - other, 1: other}, {0: 1 - rest, 1: rest}) <= 0.2 + 1 / math.sqrt(f[1])
            if good:
                near.append(f)
        sums = [Counter(), Counter()]
        for f in near or group:
            for total, share in zip(sums, f[3:]):
                total.update(share)
        own = spread(sums[0]) if near or not any(chars.values()) else spread(chars)
        shared |= {"middle": chars, "own": own} if name == "*" else {}
        refs[name] = (mix(own, "own"), spread(sums[1]))
    out = []
    for lang, n, failed, chars, share in facts:
        name, far = lang if lang in refs else "*", 0
        if name in refs and n:
            far = divergence(chars, refs[name][0]) / (0.1 + 0.6 / math.sqrt(n))
            far += divergence(share, refs[name][1]) / (0.15 + 1 / math.sqrt(n)) if name in COMMON else 0
        out.append((failed, far))
    return out


@pytest.mark.parametrize("extra", [False, True])
def test_quality_verdicts_are_those_of_plain_python(spark, extra):
    docs = parquet(spark, "documents", "0.01").select("doc_id", "text", "lang")
    if extra:
        rows = [(10**6 + k, junk_text(k, 60 + 40 * k), (None, "en", "xx", "de")[k % 4]) for k in range(24)]
        rows += [(10**7 + k, " ".join(chr(0x431 + (k * i) % 29) * (1 + i % 5) for i in range(60)), ("ru", "yy")[k % 2]) for k in range(1, 60)]
        docs = docs.where("doc_id % 3 = 0 and doc_id > 100").unionByName(table(spark, ODD + REPEATED + rows).select("doc_id", "text", "lang"))
    found = {r["doc_id"]: r for r in quality_rules(spark, docs, Scratch(spark)).where("doc_id is not null").collect()}
    rows = docs.collect()
    rejected = 0
    for r, (failed, far) in zip(rows, verdicts([(r["lang"], r["text"]) for r in rows])):
        if r["doc_id"] is not None:
            got = found[r["doc_id"]]
            assert got["base_failed"] == failed
            assert got["kept"] == (not failed and far <= 2) or abs(far - 2) < 1e-6, (r["doc_id"], far)
            rejected += not failed and far > 2
    assert rejected > 0


ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    """The contract's three patterns, written anew; re.A with re.I also folds two letters outside ASCII, which are ruled out."""
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[1]) >= 6 and m[0].isascii()]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


SECRETS = [
    (30, 'Password = "abc123def" and TOKEN: xy'), (31, "AKIA" + "B" * 16 + " AKIA" + "B" * 15), (32, "0123456789abcdef01234567"),
    (33, "😀 api_key='k9Xw/2fLq0'"), (34, 'x = "Zk8#qPw2Lm5v"\nclient_secret = x\n'), (35, "password: password: secret1"),
]


def test_secret_base_spans(spark):
    docs = table(spark, ODD + SECRETS).select("doc_id", "text").unionByName(parquet(spark, "documents").select("doc_id", "text"))
    got = sorted(str((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"])) for r in scan(docs).collect())
    want = []
    for r in docs.collect():
        b = base(r["text"] or "")
        kinds = Counter(k for _, k, _ in b)
        want.append(str((r["doc_id"], kinds[0], kinds[1], kinds[2], hashlib.sha256(",".join(x for *_, x in b).encode()).hexdigest())))
    assert got == sorted(want)


def test_secret_lexer_joins_literals_and_follows_constants():
    text = 'part = "Zk8#qPw2"\nclient_secret = part + "Lm5v!tR9"\nprint(colour = "blue green")\n'
    spans = [text[a:b] for a, _, b in all_spans(text, base_spans(text))]
    assert "Zk8#qPw2" in spans and any("Lm5v!tR9" in s for s in spans) and not any("blue" in s for s in spans)
    assert all_spans("the secret of the token is out", []) == []


def test_long_literals_are_whole_and_odd_text_is_fast():
    literal = "aB3#" * 1000
    assert (10, 3, 10 + len(literal)) in all_spans(f'authpw = "{literal}"', [])
    start = time.time()
    for text in ("a" * 200_000 + '="', 'a="' * 60_000, "'" * 100_000, 'key="\\"' * 40_000, "k=`" + "x" * 200_000):
        all_spans(text, base_spans(text))
    assert time.time() - start < 20


def literals(text):
    return sorted(text[a:b] for a, k, b in all_spans(text, base_spans(text)) if k == 3)


def test_names_constants_and_joined_parts_have_no_bound():
    assert literals("n" * 3000 + "_pwd = 'Xk29-plQ!s8'") == ["Xk29-plQ!s8"]
    assert literals("x=client_pwd=a8Zk29PqLm71==") == ["a8Zk29PqLm71=="]
    assert literals("if auth == kx82LmQp0z: pass") == []
    assert literals('p = "ab12CD"\n' + "p = p + p\n" * 3000 + "auth = p") == ["ab12CD"]
    many = "".join(f'c{i} = "v{i}Q-"\n' for i in range(12_000))
    joined = "auth = " + " + ".join(f"c{i}" for i in range(12_000))
    assert len(literals(many + joined)) == 12_000


def test_typed_declarations_pair_the_literal_with_the_name():
    secret = "Zk8#qPw2Lm5v"
    for line in (
        f'password: str = "{secret}"', f"api_key: string = '{secret}';", f'private val token: String = "{secret}"', f'let authToken: String? = "{secret}"',
        f'password: Optional[str] = "{secret}"', f"const clientSecret: string | undefined = '{secret}'", f'const API_KEY: &\'static str = "{secret}";',
        f'let secret: Option<&\'static str> = "{secret}"', f'token: typing.Dict[str, list[str]] = "{secret}"', f'password: SecretString = "{secret}"',
    ):
        assert secret in literals(line), line
    assert literals('password: SecretString = "Zk8#qPw2Lm5v"') == [secret]
    assert literals('part: str = "Zk8#qPw2"\nclient_pwd: str = part + "Lm5v!tR9"') == ["Lm5v!tR9", "Zk8#qPw2"]
    assert secret in literals(f'note: auth = "{secret}"') and secret in literals(f'error: user_pwd="{secret}"')
    assert literals('def f(auth: str, title="Blue-Green12"): pass') == [] and literals('title: str = "Blue-Green12"\ndef f(auth: str): pass') == []
    start = time.time()
    for text in ("a:[" * 60_000, "a: b::" * 40_000, "a: " + "x " * 100_000, "a: [" + "x " * 100_000, "a:" * 100_000 + '="', "a: b = " * 30_000):
        all_spans(text + "=", [])
    assert time.time() - start < 20


def test_nothing_of_a_literal_that_a_base_span_cuts_short_is_left(spark):
    values = ["abc123!@#Def$99xyz", "S3cr3t-Pass word!9x", "Zk8#qPw2Lm5v rest of it", "q2Ww<e>r4Tt,zz9"]
    rows = table(spark, [(k, f'{name} = "{v}" # end') for k, (name, v) in enumerate((n, v) for n in ("password", "db_password", "api_key") for v in values)])
    masked = [r["masked"] for r in rows.withColumn("masked", redacted("text")).collect()]
    assert len(masked) == 12
    for m in masked:
        # the name may hold a part of a value, its value may not
        shown = m.rpartition(' = "')[2]
        assert m.endswith('" # end') and not any(part in shown for v in values for part in re.split("[^A-Za-z0-9]", v) if len(part) > 2 and part != "end"), m


def test_forms_in_which_files_assign():
    secret = "Zk8#qPw2Lm5v"
    for text in (
        f'api_key = k\nk = "{secret}"', f'client_secret = a\na = b\nb = "{secret}"', f'private_key = """\n{secret}\n"""', f"signing_key = '''{secret}'''",
        f"<password>{secret}</password>", f'<add key="ApiKey" value="{secret}"/>', f"db:\n  passphrase: |\n    {secret}\n  user: bob",
    ):
        assert any(secret in x for x in literals(text)), text
    for text in ('secret_name = "my-service-account-name"', 'author: "Jane-Smith12"', 'tokenizer = "Piece-Model32k"', 'passphrase: "ask the team lead"', f'db:\n  title: |\n    {secret}\n', 'credential = "<your-Cred3ntial>"'):
        assert literals(text) == [], text


def test_redaction_masks_every_base_span(spark):
    rows = table(spark, ODD + SECRETS).withColumn("masked", redacted("text")).collect()
    for r in rows:
        assert (r["masked"] is None) == (r["text"] is None)
        if r["text"] is not None:
            assert not any(r["text"][a:b] in r["masked"] for a, _, b in base_spans(r["text"]))
            assert base_spans(r["text"]) or "secret" in r["text"] or r["masked"] == r["text"]


def test_token_counts_match_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    odd = [(40, "  two  spaces  "), (41, "▁▁ marks"), (42, "<s> </s> <unk> [INST]"), (43, "a" * 5000), (44, "\r\n\t"), (45, "日本語 ﬁ Å"), (46, "x")]
    docs = table(spark, ODD + odd).select("doc_id", "text").unionByName(parquet(spark, "documents").select("doc_id", "text"))
    got = sorted(str(tuple(r)) for r in token_counts(docs).collect())
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(model.encode(r["text"] or "")), n > 4096) for r in docs.collect()]
    assert got == sorted(map(str, want))


@pytest.mark.parametrize("run", [lambda s, d: quality_rules(s, d, Scratch(s)), lambda s, d: scan(d), lambda s, d: token_counts(d)])
def test_empty_table(spark, run):
    assert run(spark, table(spark, [])).count() == 0


def test_secret_lexer_scores_short_and_many_word_literals():
    assert literals('pwd = "hunter2"') == ["hunter2"]
    assert literals("pwd: hunter2") == ["hunter2"]
    assert literals('passphrase = "correct horse battery staple seven hills"') == ["correct horse battery staple seven hills"]
    for text in ("pwd = None", "pwd = user", "tokens = 12345", 'pwd = "int"', 'passphrase: "must contain upper case lower case digits"', 'pwd = "please enter the password of your account"'):
        assert literals(text) == [], text


def test_secret_lexer_reads_nested_values_lists_arguments_and_templates():
    secret, other = "Zx81kqPw92Lm", "Qq77aaBB12#k"
    for text in (
        f'{{"auth": {{"value": "{secret}"}}}}', f'passphrases = ["{secret}"]', f'passphrase = decode("{secret}")', f"auth:\n  value: {secret}\n", f"passphrases:\n- {secret}\nuser: bob\n",
        f'credential = f"{{prefix}}{secret}"', f"credential = `${{prefix}}{secret}`", f'credentials: {{live: {{data: ["{secret}"]}}}}', f'k = "{secret}"\nauth = f"Bearer {{k}}"',
    ):
        assert literals(text) == [secret], text
    assert literals(f'passphrases = ["{secret}", "{other}"]') == [other, secret]
    for text in (
        'credential = lookup("GITHUB_ACCOUNT9")', 'pwd = getpass("Type it here: ")', "auth = `Bearer ${jwt}`", f'{{"auth": {{"user": "{secret}"}}}}', 'auth: (see "Figure A12b" below)', f'auth:\n  title: {secret}\n', "passphrases:\n- Identification\n",
    ):
        assert literals(text) == [], text


def test_secret_lexer_keeps_the_constants_of_functions_apart():
    first, second = "Zk8#qPw2Lm5v", "Zq9#rrrW2Lm5v"
    text = f'def a():\n    client_secret = k\n    k = "{first}"\n\ndef b():\n    k = "plain text here"\n    return k\n'
    assert first in literals(text)
    assert "plain text here" not in literals(text)
    outer = f'k = "{second}"\n\ndef a():\n    k = "{first}"\n\ndef b():\n    client_secret = k\n'
    assert literals(outer) == [second]
    assert first in literals(f'def a():\n    k = "{first}"\n\ndef b():\n    client_secret = k\n')


@pytest.mark.parametrize("line", [lambda i, n: f"token{i} = token{i + 1}", lambda i, n: f"token{n - i} = token{n - i - 1}", lambda i, n: f'k{i} = k{i - 1} + "Ab3"', lambda i, n: "  " * (i % 50) + f"def f{i}(a):", lambda i, n: "auth: (", lambda i, n: "auth:"])
def test_secret_lexer_follows_long_chains_once(line):
    def took(n: int) -> float:
        text = "\n".join(line(i, n) for i in range(n))
        start = time.process_time()
        all_spans(text, base_spans(text))
        return time.process_time() - start

    assert took(20_000) < 12 * took(4_000) + 1


def test_secret_lexer_ends_chains_that_close():
    assert literals("a = b\nb = a\npwd = a") == []


def test_secret_lexer_reads_empty_and_torn_quotes_in_brackets():
    secret = "Zx81kqPw92Lm"
    assert literals(f'passphrases = ["", "{secret}"]') == [secret]
    assert literals(f'passphrases = [\n  "{secret}",  # don\'t\n  "Q{secret}",\n]') == [f"Q{secret}", secret]
    start = time.process_time()
    for text in ("auth: (" + '"\\' * 100_000, "auth: (" + "'\\" * 100_000, "auth: [" + "`x\n" * 50_000, "auth: [" + "'''" * 50_001):
        all_spans(text, base_spans(text))
    assert time.process_time() - start < 20

"""License and secret scans, language ID, against brute force and on odd tables."""

import base64
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import language, licenses, secrets
from verdigris.llm import textops as X
from verdigris.llm.bpe import VOCABULARY


def shingles_of(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return list(zip(words, words[1:]))


def brute_licenses(text, least=0.9):
    """{license: containment} of windows at any place; a set of all places at which the best is reached as well."""
    own, found = shingles_of(text), {}
    sets = [(name, set(shingles_of(t))) for name, t in licenses.TEMPLATES]
    for name, t in sets:
        related = [(u, n) for n, u in sets if n != name and len(t & u) >= 0.6 * len(t)]
        need = {x for u, _ in related if t - u for x in t - u}
        size = 2
        while size < 1.25 * len(t):
            size *= 2
        for i in range(max(1, len(own))):
            window = set(own[i : i + size])
            n = len(t & window)
            if n < least * len(t) and n < max(len(t) - 2, 4) or not need <= window:
                continue
            if any(not t - u and len(u) > len(t) and u - t <= window for u, _ in related):
                continue
            found.setdefault(name, {}).setdefault(n / len(t), set()).add(i)
    return found


def test_licenses_are_those_of_brute_force(make, prose):
    rng = random.Random(3)
    texts = []
    for i, text in enumerate(prose(160, words=60)):
        words = text.split()
        for name, template in rng.sample(licenses.TEMPLATES, i % 3):
            t = template.split()
            if len(t) > 5 and i % 2:
                t[rng.randrange(len(t))] = "altered"
            words[(at := rng.randrange(len(words))) : at] = [x.upper() if i % 5 == 0 else x for x in t]
        texts.append(" ".join(words))
    got = {(r.doc_id, r.license): (r.containment, r.first_word) for r in licenses.scan_licenses(make(texts)).collect()}
    want = {(i, name): x for i, t in enumerate(texts) for name, x in brute_licenses(t).items()}
    assert len(want) > 100 and set(got) <= set(want) and len(got) >= 0.97 * len(want)
    # windows are on a grid: what is found is found at that place by brute force too, and mostly the best there is
    assert all(word in want[k].get(share, ()) for k, (share, word) in got.items())
    assert np.mean([got[k][0] == max(want[k]) for k in got]) > 0.9


def test_every_template_is_found_and_others_are_not(make):
    texts = [t for _, t in licenses.TEMPLATES] + ["Licensed under nothing at all", "the MIT campus", "version 2.0"]
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(make(texts)).collect()}
    assert {(i, n) for i, (n, _) in enumerate(licenses.TEMPLATES)} <= got
    assert not {i for i, _ in got} & {len(texts) - 1, len(texts) - 2, len(texts) - 3}
    with pytest.raises(ValueError):
        licenses.Templates([("X", "mit license")])


def test_related_licenses_are_told_apart(make):
    lesser = "under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
    texts = {
        lesser.format("Affero General Public License", 3): {"AGPL-3.0-or-later"},
        lesser.format("Lesser General Public License", "2.1"): {"LGPL-2.1-or-later"},
        lesser.format("General Public License", 2): {"GPL-2.0-or-later"},
        "SPDX-License-Identifier: GPL-2.0-or-later": {"GPL-2.0-or-later"},
        "SPDX-License-Identifier: MIT-0": {"MIT-0"},
        "SPDX-License-Identifier: MIT": {"MIT"},
        "Licensed under CC BY-NC-SA 4.0": {"CC-BY-NC-SA-4.0"},
        "Licensed under the Apache License, Version 1.1": {"Apache-1.1"},
        "it is Licensed under an Apache License, Version 2.0 here": {"Apache-2.0"},
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": {"BSD"},
    }
    got = {i: set() for i in range(len(texts))}
    for r in licenses.scan_licenses(make(list(texts))).collect():
        got[r.doc_id].add(r.license)
    assert list(got.values()) == list(texts.values())


def test_a_copy_is_missed_as_rarely_as_said(prose):
    """Copies of a notice among other words, one word changed: windows are looked at, and verified, nearly always."""
    known = licenses.Templates(licenses.TEMPLATES)
    rng, missed, tried = random.Random(6), 0, 0
    words = " ".join(prose(300, words=60)).split()
    for k, (name, template) in enumerate(licenses.TEMPLATES):
        for _ in range(8):
            t = template.split()
            at = rng.randrange(len(words) - 40)
            text = " ".join(words[at : at + 20] + t + words[at + 20 : at + 40])
            buf = np.frombuffer(text.encode() + bytes(X.PAD), np.uint8)
            found = {known.names[i] for i, *_ in known.matches(*licenses.shingles(buf, np.array([0, len(buf) - X.PAD])), 0.9)}
            missed, tried = missed + (name not in found), tried + 1
    assert missed <= tried * 0.002


def test_a_template_beyond_a_rows_end(make):
    """Half a template at the end of a row and half at the next one's beginning is none."""
    assert licenses.scan_licenses(make(["text Licensed under the Apache", "License, Version 2.0 more"])).count() == 0


@pytest.mark.parametrize("scan", [licenses.scan_licenses, secrets.scan_secrets])
def test_scans_of_odd_tables(make, odd, scan):
    df = make(odd, ids=[None] * len(odd))
    assert scan(df).count() == 0 and scan(df.limit(0)).count() == 0
    hit = 'Released under the MIT License. token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"'
    rows = scan(make([hit, hit, "z " * 50_000 + hit], ids=[None, 4, 4])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 4), (False, 4), (True, 0)]


def brute_secrets(text, encode):
    """By regular expressions over str, string by string."""
    names = "token|secret|password|passwd|passwrd|pwd|credential|bearer|auth|authorization|api.?key|access.?key|private.?key"
    digest = r"(?i)((md5|sha1|sha256|sha512)[-=_])?([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
    shape = r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|\d{4}-\d\d-\d\d([T_-][\d-]+)?[A-Z]*|[A-Z]{0,10}[_-]?v?\d+([_-]\d+)*([_-][A-Z]{1,10})?|(ISBN|ISSN|DOI)[\d=X-]+"
    out, text = set(), text or ""
    for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
        settled = []
        for piece in (r".+", r"[^/]+", r"[^_-]+"):
            for part in re.finditer(piece, m.group()):
                s = part.group().lstrip("-")
                end = m.start() + part.end()
                start = end - len(s)
                if any(a <= start and end <= b for a, b in settled):
                    continue
                pad = re.match(r"={1,2}(?![A-Za-z0-9+/_=-])", text[end:])
                if end == m.end() and pad:
                    end += pad.end()
                s = text[start:end]
                if len(s) < 8 or not re.search("[A-Za-z]", s):
                    continue
                has_digit = re.search("[0-9]", s) is not None
                if not has_digit and (not s.isalpha() or len(s) < 16):
                    continue
                n = len(encode(s))
                assigned = re.search(rf"(?i)({names})s?[^A-Za-z0-9\n]{{1,16}}$", text[max(0, start - 48) : start]) is not None
                if len(s) / n > (2.2 if has_digit else 1.5):
                    if has_digit and (re.fullmatch(shape, s) or re.fullmatch(digest, s)):
                        settled.append((start, end))
                    continue
                if len(s) < (8 if assigned and has_digit else 16):
                    continue
                settled.append((start, end))
                if not re.fullmatch(shape, s) and (assigned or not re.fullmatch(digest, s)):
                    out.add((len(text[:start].encode()), len(s), n, assigned))
    return out


@pytest.fixture(scope="module")
def tiktoken_encode():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_secrets_are_those_of_brute_force(make, prose, tiktoken_encode):
    rng = random.Random(1)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    kinds = [
        lambda: "key " + "".join(rng.choices(alnum, k=24)),
        lambda: 'token = "' + rng.randbytes(20).hex() + '"',
        lambda: 'TOKEN### = "' + rng.randbytes(20).hex().upper() + '"!!',
        lambda: "sha1 " + rng.randbytes(20).hex(),
        lambda: "é " + base64.b64encode(rng.randbytes(30)).decode(),
        lambda: "id 123e4567-e89b-12d3-a456-426614174000 2024-01-05T10-20-30 4785380592391139",
        lambda: "see http2_server_connection_handler_v2 and model_v2_checkpoint_2023_final",
        lambda: "database_connection_password=" + "".join(rng.choices(alnum, k=16)),
        lambda: "client_secret=" + rng.randbytes(8).hex() + "&x=1",
        lambda: "at https://x.example/services/webhooks/incoming/production/" + "".join(rng.choices(alnum, k=24)),
        lambda: "commit=" + rng.randbytes(20).hex() + " etag=" + rng.randbytes(16).hex() + " id=123e4567-e89b-12d3-a456-426614174000",
        lambda: "mixed " + "".join(rng.choices(alnum[:52], k=24)),
        lambda: base64.b64encode(rng.randbytes(31)).decode() + "\n--x==y",
    ]
    texts = []
    for i, t in enumerate(prose(26 * len(kinds) // 2)):
        words = t.split()
        words.insert(rng.randrange(len(words)), kinds[i % len(kinds)]())
        texts.append(" ".join(words))
    got = {}
    for r in secrets.scan_secrets(make(texts)).collect():
        got.setdefault(r.doc_id, set()).add((r.start_byte, r.n_chars, r.n_tokens, r.assigned))
    want = {i: s for i, t in enumerate(texts) if (s := brute_secrets(t, tiktoken_encode))}
    assert got == want
    share = [np.mean([i in got for i in range(k, len(texts), len(kinds))]) for k in range(len(kinds))]
    assert min(share[k] for k in (0, 1, 2, 4, 7, 8, 9, 12)) >= 0.9 and share[11] >= 0.5 and max(share[k] for k in (3, 5, 6, 10)) == 0


def test_a_value_is_found_without_its_name(make):
    """Names before '=' aren't part of what is found; ties are two rows; short ones count where they are assigned."""
    value = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"
    df = make([f"token={value} {value}", f"commit={value}", 'the "password": "Tr0ub4dor&3!"', "kJ8s0Qp2Lx9v", f"token={value} token={value}"])
    got = sorted((r.doc_id, r.start_byte, r.n_chars, r.assigned) for r in secrets.scan_secrets(df).collect())
    assert got == [(0, 6, 40, True), (2, 17, 9, True), (4, 6, 40, True), (4, 53, 40, True)]


def test_known_strings_are_no_secrets(spark, make):
    df = make(["public kJ8s0Qp2Lx9vB4nT7wZ1 here"])
    assert secrets.scan_secrets(df).count() == 1
    assert secrets.scan_secrets(df, known=spark.createDataFrame([("kJ8s0Qp2Lx9vB4nT7wZ1",)], "s string")).count() == 0


def page(text, lang=None):
    return f"<html{f' lang={chr(34)}{lang}{chr(34)}' if lang else ''}><head><script>var the = 1</script></head><body><p>{text}</p></body></html>"


def test_language_is_that_of_brute_force(spark, make, prose):
    en, de = prose(30), ["ß" + t.replace("th", "sch").replace("an", "ung") for t in prose(30, seed=1)]
    docs = make(en + de, langs=["en"] * 30 + ["de"] * 30)
    new_en, new_de = prose(12, seed=7), ["ß" + t.replace("th", "sch").replace("an", "ung") for t in prose(12, seed=8)]
    rows = [(i, f"http://h{i % 3}.example.org/a", page(t, "en")) for i, t in enumerate(new_en)] + [(20 + i, f"https://u@x.seite.de:80/{i}", page(t, "de-AT" if i % 4 else None)) for i, t in enumerate(new_de)]
    rows += [(40, "http://x.seite.de/leer", page("")), (41, None, page("")), (42, "kein host", None), (43, "http://x.seite.de/kurz", page("ha")), (44, "http://neu.de/", None)]
    out = language.identify_languages(spark.createDataFrame(rows, "page_id long, url string, html string"), language.text_model(docs))
    got = {r.page_id: r for r in out.collect()}
    assert all(got[i].lang == "en" for i in range(12)) and all(got[20 + i].lang == "de" for i in range(12))
    assert got[40].text_lang is None and got[40].lang == got[43].lang == got[44].lang == "de"
    assert got[20].declared is None and got[21].declared == "de" and got[21].host == "x.seite.de" and got[42].host is None

    # the fusion, page by page
    model = language.text_model(docs)
    langs, logs = model.langs, model.logs()[2]
    n, parsed = len(langs), []
    for i, url, html in rows:
        text = re.sub(r"(?is)<script\b.*?</script\s*>|<[^>]*>", " ", html or "").strip()
        buf = np.frombuffer(text.encode() + bytes(X.PAD), np.uint8)
        g = language.Grams(buf, np.array([0, len(buf) - X.PAD]), np.zeros(1, np.int64), 3)
        bucket = (g.hashes(3) >> np.uint64(64 - language.BUCKET_BITS)).astype(int)
        score = logs[:, bucket].sum(axis=1) / (language.UNIT * 3)
        host = (re.match(r"\w+://(?:[^/@]*@)?([^/:]+)", url or "") or [None, None])[1]
        declared = (re.search(r'<html lang="(\w+)', html or "") or [None, None])[1]
        dots = host.split(".") if host else []
        parsed.append((i, int(score.argmax()) if text else None, score, host, ".".join(dots[-2:]) if dots[1:] else None, dots[-1] if dots[1:] else None, declared))

    def votes(keep, skip):
        return np.array([sum(1 for p in parsed if p is not skip and p[1] == k and keep(p)) for k in range(n)], float)

    kinds = [len({p[6] for p in parsed if p[6] is not None})]
    for p in parsed:
        prior = (votes(lambda q: True, p) + language.PRIOR_WEIGHT / n) / (votes(lambda q: True, p).sum() + language.PRIOR_WEIGHT)
        for k in (5, 4, 3):
            if p[k] is not None:
                v = votes(lambda q: q[k] == p[k], p)
                prior = (v + language.PRIOR_WEIGHT * prior) / (v.sum() + language.PRIOR_WEIGHT)
        total = np.log(prior) + p[2]
        for k, m in zip((6,), kinds):
            if p[k] is not None:
                total += np.log((votes(lambda q: q[k] == p[k], p) + language.EVIDENCE_ALPHA) / (votes(lambda q: q[k] is not None, p) + language.EVIDENCE_ALPHA * (m + 1)))
        assert got[p[0]].lang == langs[int(total.argmax())]
        assert abs(got[p[0]].probability - 1 / np.exp(total - total.max()).sum()) < 1e-6


def test_language_held_out(spark, make):
    """Trained on most documents of the smallest tables, right for the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train, rest = docs.filter("doc_id % 5 > 0"), docs.filter("doc_id % 5 = 0 AND n_chars > 100")
    pages = rest.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), "text").withColumnRenamed("text", "html")
    got = language.identify_languages(pages, language.text_model(train)).join(rest.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("truth")), "page_id")
    r = got.agg(F.avg((F.col("lang") == F.col("truth")).cast("int"))).first()[0]
    assert r > 0.9


def test_plain_texts_are_judged_as_they_stand(spark, make, prose):
    """What stands between '<' and '>' in a plain text counts; in markup it doesn't."""
    de = ["ß" + t.replace("th", "sch").replace("an", "ung") for t in prose(30, seed=1)]
    model = language.text_model(make(prose(30) + de, langs=["en"] * 30 + ["de"] * 30))
    rows = [(0, None, "< " + " ".join(de[:5]) + " > " + prose(1, words=10, seed=3)[0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert language.identify_languages(df, model, plain=True).first().text_lang == "de"
    assert language.identify_languages(df, model).first().text_lang == "en"


def test_a_document_does_not_vouch_for_itself(spark, make, prose):
    """One odd text, labelled xx with its copies, is not taken for xx on its own count's word."""
    odd = " ".join(["qqzz xxyy"] * 50)
    docs = make(prose(40) + [odd, odd], langs=["en"] * 40 + ["xx"] * 2)
    model = language.text_model(docs)
    assert model.langs == ["en", "xx"] and (model.counts[:, 1].sum(axis=1) > 0).sum() == 1
    pages = spark.createDataFrame([(0, None, odd)], "page_id long, url string, html string")
    mine = language.identify_languages(pages, model, plain=True, counted=True).first()
    other = language.identify_languages(pages, model, plain=True).first()
    assert other.lang == "xx" and other.probability > mine.probability or mine.lang != "xx"
    assert language.text_model(docs, most_languages=1).langs == ["en"]


def test_hosts_and_their_parts(spark):
    df = spark.createDataFrame([("www.bbc.co.uk",), ("a.b.example.org",), ("localhost",), (None,), ("x.de",)], "h string")
    got = [tuple(r) for r in df.select(language.domain_of(F.col("h")), language.suffix_of(F.col("h"))).collect()]
    assert got == [("bbc.co.uk", "uk"), ("example.org", "org"), (None, None), (None, None), ("x.de", "de")]


def test_ties_and_clashing_names(spark, make):
    """Equal posteriors go to the first name; the pages' other columns don't matter, whatever their names."""
    model = language.text_model(make(["same text"] * 2, langs=["bb", "aa"]))
    pages = spark.createDataFrame([(1, None, "same text", "x", 1, 2.0)], "page_id long, url string, html string, lang string, vote int, prior double")
    row = language.identify_languages(pages, model).first()
    assert row.lang == "aa" and abs(row.probability - 0.5) < 1e-9


def test_language_of_odd_tables(spark, make, odd):
    pages = spark.createDataFrame([(None, None, t) for t in odd], "page_id long, url string, html string")
    assert language.identify_languages(pages, language.text_model(make(odd))).count() == len(odd)
    assert language.identify_languages(pages.limit(0), language.text_model(make(odd))).count() == 0
    nothing = language.identify_languages(pages, language.text_model(make(odd).limit(0)))
    assert nothing.count() == len(odd) and nothing.filter("lang IS NOT NULL").count() == 0
    no_lang = language.identify_languages(pages, language.text_model(make(odd, langs=[None] * len(odd))))
    assert no_lang.filter("lang IS NOT NULL").count() == 0



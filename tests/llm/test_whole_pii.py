"""Surrogates of entities without ASCII letters or digits, of crowded name roles, and of overrides that are joined."""

import re
from itertools import product

from proofmill.llm import pii


def test_other_scripts_and_signs(spark):
    texts = ["password: ********", "password: !$%^&*", "mail имя@почта.рф now", "mail ___@___.com now", "mail δοκιμή@x.gr now", "secret=пароль日本語", "Dr דוד said", "password: ******1"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_pii(table).collect()}
    assert got[0].text == texts[0] and got[0].pii == []
    for i, hidden in {1: "!$%^&*", 2: "имя@почта", 3: "___@___", 4: "δοκιμή", 5: "пароль", 6: "דוד", 7: "******1"}.items():
        assert hidden not in got[i].text and len(got[i].text) == len(texts[i]), got[i].text
    assert re.fullmatch(r"mail [а-я]{3}@[а-я]{5}\.рф now", got[2].text) and "日本語" not in got[5].text
    assert re.fullmatch(r"Dr [\u0590-\u05ff]{3} said", got[6].text)


def test_crowded_formats_are_served(spark):
    """More Greek names than three syllables give, and every one-digit secret of a format."""
    names = ["".join(x) for x in product("αβγδεζηθικλμ", repeat=4)][:14_500]
    rows = [("family", n, pii.surrogate("family", n, 0)) for n in names] + [("secret", f"*****{i}", pii.surrogate("secret", f"*****{i}", 0)) for i in range(10)]
    again = pii.collision_overrides(spark.createDataFrame(rows, "kind string, form string, new string"))
    new = {(kind, pii.surrogate(kind, form, again.get((kind, form), 0)).lower()) for kind, form, _ in rows}
    assert len(new) == len(rows) and new.isdisjoint((kind, form) for kind, form, _ in rows)


def test_joined_overrides_equal_broadcast(spark):
    rows = [(i, f"password: *****{i % 10} and Dr Smith", None if i % 2 else "x") for i in range(20)] + [(99, None, "y"), (3, "plain", "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    one, two = (sorted((tuple(r) for r in pii.replace_pii(table, held=h).collect()), key=str) for h in (0, 1000))
    assert one == two and len(one) == len(rows) and len({r[1] for r in one}) == 12


def test_keys_particles_and_ipv6(spark, monkeypatch):
    texts = ["Mr. van Dyke and Mrs O'Brien met; Dyke left", "at 2001:0db8:85a3:0000:0000:8a2e:0370:7334 now", "Frau von der Leyen"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = [r.text for r in pii.replace_pii(table, b"a key").orderBy("doc_id").collect()]
    assert re.fullmatch(r"Mr\. van (\w+) and Mrs \w+ met; (\1) left", one[0]) and "Dyke" not in one[0] and "Brien" not in one[0]
    assert re.fullmatch(r"at (?:[0-9a-f]{4}:){7}[0-9a-f]{4} now", one[1]) and one[1] != texts[1]
    assert one[2].startswith("Frau von der ") and "Leyen" not in one[2]
    two = [r.text for r in pii.replace_pii(table, b"another").orderBy("doc_id").collect()]
    assert two[1] != one[1] and two[0] != one[0]
    monkeypatch.setattr(pii, "surrogate_key", lambda spark: b"a key")
    assert [r.text for r in pii.replace_pii(table).orderBy("doc_id").collect()] == one


def test_distinct_and_coreferent_over_a_corpus(spark):
    import random

    rng = random.Random(31)
    mails = [f"user{i}@mail{i % 7}.example.org" for i in range(150)]
    names = [a.title() + b for a in ("ander", "berg", "holm", "lind", "ström", "quist") for b in ("a", "en", "er", "man", "son", "berg", "lund")]
    rows = []
    for i in range(300):
        m, n = rng.choice(mails), rng.choice(names)
        rows.append((i, f"Dr. {n} wrote from {m}. {n} is at 10.{i % 9}.{i % 31}.{i % 250}.", m, n))
    table = spark.createDataFrame(rows, "doc_id long, text string, m string, n string")
    images = {}
    for r in pii.replace_pii(table, b"k").collect():
        found = re.fullmatch(r"Dr\. (\w+) wrote from (\S+@\S+)\. (\w+) is at (\S+)\.", r.text)
        assert found and found[1] == found[3], r.text
        for old, new in ((r.m, found[2]), (r.n, found[1])):
            assert images.setdefault(old, new) == new and new != old
    assert len(set(images.values())) == len(images) and not set(images.values()) & set(images)


def test_names_in_any_case_and_their_mentions():
    done, kinds = pii.rewrite("Mr. McDonald left. McDonald ran. Mr JOHN SMITH and LeBron; Dr LeBron met John Smith, SMITH and O'Neill.", {})
    for part in ("McDonald", "Donald", "JOHN", "SMITH", "LeBron", "John", "Smith"):
        assert part not in done
    assert "O'Neill" in done  # without a title
    first, second = done.split(" left. ")[0].removeprefix("Mr. "), done.split(" left. ")[1].split(" ran")[0]
    assert first == second
    assert kinds.count("family") >= 5


def test_more_formats():
    text = "from 2001:db8::1 or fe80::1 or ::1, call 030 1234567 or 0170/1234567, SSN 123 45 6789; std::vector and a::b stay, so does 12:30"
    done, kinds = pii.rewrite(text, {})
    assert kinds == ["ipv6", "ipv6", "ipv6", "phone", "phone", "social"]
    for part in ("2001:db8::1", "fe80::1", "1234567", "123 45 6789"):
        assert part not in done
    assert "std::vector and a::b stay, so does 12:30" in done


def test_a_domain_has_one_surrogate():
    done, _ = pii.rewrite("ann@corp.example and bob.k@corp.example, not ann@firm.example", {})
    hosts = re.findall(r"@([\w.]+)", done)
    assert hosts[0] == hosts[1] != hosts[2] and "corp" not in done
    assert re.findall(r"(\w+)@", done)[0] != "ann"


def test_full_formats_settle(spark):
    """Every string of a format occurs: the permutation alone keeps them apart."""
    found = spark.createDataFrame([(1, " ".join(f"::{i}" for i in range(10)) + " " + " ".join(f"10.0.0.{i}" for i in range(256)))], "doc_id long, text string")
    done = pii.replace_pii(found, b"k").first()
    assert len(set(done.text.split())) == 266

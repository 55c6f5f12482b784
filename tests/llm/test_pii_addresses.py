"""Addresses behind a spelled "at": disguises are found, prose with "at" and a domain stays."""

import itertools

from lodestead.llm import pii

DOMAINS = ("noon.com", "amazon.com", "cafe.de", "github.com", "example.org", "python.org", "mail.bbc.co.uk", "ibm.com", "shop.fr", "data.gov")
PROSE = (
    "I will reach you at {}.", "We mail it at {} on Mondays.", "Meet at 10 at {} then.", "Use version2 at {} instead.", "She works at {} now.",
    "You can contact us at {} or by phone.", "Our address was listed at {} for years.", "Send them at {} a note.", "He looked at {} for an hour.", "Contact people at {} about it.",
    "The file README.md at {} says so.", "They met at 5 p.m. at {} again.", "Write to someone at {} today.", "Sign-up at {} is free.", "Download setup.exe at {} first.",
    "I emailed the team yesterday; lunch at {} was fine.", "We reach 200 at {} each day.", "Kontakt gibt es nicht, alle arbeiten at {} hier.", "Please send everything at {} back.", "It is available at {} for all.")
PEOPLE = ("jane", "john.doe", "ann78", "support", "m_lopez", "kim-lee", "o.brien", "sales", "zoe", "peter99")
#: name and domain to a disguise; what of it must be found
DISGUISES = (
    ("mail {n} at {d}", "{n} at {d}"), ("My address is {n} at {d}", "{n} at {d}"), ("contact: {n} at {d}", "{n} at {d}"), ("Reach me at {n} at {d}", "{n} at {d}"),
    ("write to {n} at {d}", "{n} at {d}"), ("so {n} [at] {d}", "{n} [at] {d}"), ("so {n} (at) {d}", "{n} (at) {d}"), ("x {n} {{at}} {d}", "{n} {{at}} {d}"),
    ("x {n}&#64;{d}", "{n}&#64;{d}"), ("x {n} @ {d}", "{n} @ {d}"), ("or {n} at {sd}", "{n} at {sd}"), ("or {n} (at) {bd}", "{n} (at) {bd}"), ("or {n}[at]{bd}", "{n}[at]{bd}"),
    ("or {sn} at {sd}", "{sn} at {sd}"), ("or {n}_at_{d}", "{n}_at_{d}"), ("schreib mir an {n} at {d}", "{n} at {d}"), ("correo: {n} at {d}", "{n} at {d}"),
    ("Email him: {n} at {d}", "{n} at {d}"), ("send it to {n} at {d}", "{n} at {d}"), ("or {n} <at> {sd}", "{n} <at> {sd}"))


def test_prose_stays():
    texts = [p.format(d) for p, d in itertools.product(PROSE, DOMAINS)]
    wrong = [t for t in texts if pii.find_all(t)[1]]
    assert len(texts) == 200 and not wrong


def test_disguises_are_found():
    missed, n = [], 0
    for (text, part), i in itertools.product(DISGUISES, range(10)):
        name, domain = PEOPLE[i], DOMAINS[i]
        forms = {"n": name, "d": domain, "sd": domain.replace(".", " dot "), "bd": domain.replace(".", "[.]"), "sn": name.replace(".", " dot ")}
        whole, wanted = text.format(**forms) + " if you like", part.format(**forms)
        n += 1
        if not any(whole[a:z] == wanted and k == 0 for a, z, k in pii.find_all(whole)[1]):
            missed.append(whole)
    assert n == 200 and not missed


def test_addresses_in_paths_stay():
    for t in ("see www.lunch-at-work.de here", "http://look-at-me.com/x", "a look-at-me.com page"):
        assert pii.find_all(t)[1] == []


def test_a_long_text_without_blanks():
    text = "ab" * 500_000 + "[at]example.org" + "cd" * 500_000
    (a, z, k), = pii.find_all(text)[1]
    assert (a, z, k) == (0, len(text), 0)

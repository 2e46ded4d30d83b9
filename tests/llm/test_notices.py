"""Licence notices with words put in, left out or changed."""

import random

from logsift.llm import license_scan

GPL2 = (
    "This program is free software; you can redistribute it and/or modify it under the terms of version 2 "
    "of the GNU General Public License as published by the Free Software Foundation"
)


def _labels(text):
    return license_scan.scan_text(license_scan.Index(100, {}), text)[5].split(",")


def test_words_put_in_or_left_out_do_not_hide_a_notice():
    assert "gpl-notice" in _labels(GPL2)
    assert "gpl-notice" in _labels("filler words " * 50 + GPL2 + " more words" * 50)
    for label, (text, phrases) in license_scan.TEMPLATES.items():
        words = text.split()
        for at in range(1, len(words)):
            more = " ".join([*words[:at], "put", "in", "here", *words[at:]])
            less = " ".join(words[: at - 1] + words[at:])
            for changed in (more, less):
                whole = all(f" {p} " in f" {changed} " for p in phrases)
                assert (label in _labels(changed)) == whole
    # the rarest words of the corpus may be those that are missing
    frequency = {w.encode(): 90 for w in "gnu general public license free software foundation".split()}
    index = license_scan.Index(100, frequency)
    assert "gpl-notice" in license_scan.scan_text(index, GPL2.replace("redistribute it", "share it"))[5]


def test_phrases_without_the_notice_are_none():
    assert "gpl-notice" not in _labels("the GNU General Public License is by the Free Software Foundation, they say")
    words = license_scan.TEMPLATES["mit"][0].split()
    far = " ".join([*words[:15], *["other"] * 40, *words[15:]])
    assert "mit" not in _labels(far)


def _longest_common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[-1]))
        best = row
    return best[-1]


def _plain_labels(text):
    """Every window of every file against every template."""
    words = list(license_scan._split(text))
    out = {}
    for template in license_scan.templates():
        size = template.window
        for start in range(len(words)):
            window = words[start : start + size]
            if all(any(tuple(window[i : i + len(p)]) == p for i in range(len(window))) for p in template.phrases):
                share = _longest_common(template.words, window) / len(template.words)
                if share >= license_scan.SHARE - 1e-9:
                    out[template.label] = max(out.get(template.label, 0), share)
    return out


def test_every_window_is_found():
    """Random words put in, left out and repeated, against a plain comparison of all windows."""
    random.seed(11)
    index = license_scan.Index(1000, {b"license": 900, b"the": 990, b"gnu": 3, b"of": 950})
    hits = 0
    for _ in range(250):
        text = ["lead"] * random.randrange(4)
        for _ in range(random.randrange(1, 3)):
            label = random.choice(list(license_scan.TEMPLATES))
            words = license_scan.TEMPLATES[label][0].split()
            for _ in range(random.randrange(14)):
                at = random.randrange(len(words))
                action = random.randrange(4)
                if action == 0:
                    words.insert(at, random.choice(["put", "license", "the", "of"]))
                elif action == 1 and len(words) > 3:
                    del words[at]
                elif action == 2:
                    words[at:at] = ["more", "words"]
                else:
                    words[at:at] = words[at : at + 2]
            text += words + ["tail"] * random.randrange(3)
        found = license_scan.scan_text(index, " ".join(text))
        want = _plain_labels(" ".join(text))
        own = set(found[5].split(",")) - set(license_scan.BASE.values()) - {""}
        assert own == set(want) and abs(found[6] - max(want.values(), default=0)) < 1e-12
        hits += bool(want)
    assert hits > 100


def test_many_words_put_in_are_a_share_of_the_template():
    words = license_scan.TEMPLATES["mit"][0].split()
    for many in range(12):
        text = " ".join([*words[:20], *["more"] * many, *words[20:]])
        assert ("mit" in _labels(text)) == ("mit" in _plain_labels(text))
    assert "mit" in _labels(" ".join([*words[:20], *["more"] * 5, *words[20:]]))

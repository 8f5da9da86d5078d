"""A small lemma table of our own (form, part of speech, lemma): a stand-in for the one a user supplies."""

from __future__ import annotations

DEFAULT_LEMMAS = (
    ("am", "v", "be"), ("are", "v", "be"), ("is", "v", "be"), ("was", "v", "be"), ("were", "v", "be"),
    ("been", "v", "be"), ("being", "v", "be"), ("has", "v", "have"), ("had", "v", "have"),
    ("having", "v", "have"), ("does", "v", "do"), ("did", "v", "do"), ("done", "v", "do"),
    ("went", "v", "go"), ("gone", "v", "go"), ("goes", "v", "go"), ("made", "v", "make"),
    ("said", "v", "say"), ("says", "v", "say"), ("took", "v", "take"), ("taken", "v", "take"),
    ("came", "v", "come"), ("comes", "v", "come"), ("saw", "v", "see"), ("seen", "v", "see"),
    ("knew", "v", "know"), ("known", "v", "know"), ("got", "v", "get"), ("gave", "v", "give"),
    ("given", "v", "give"), ("found", "v", "find"), ("thought", "v", "think"), ("told", "v", "tell"),
    ("became", "v", "become"), ("left", "v", "leave"), ("felt", "v", "feel"), ("brought", "v", "bring"),
    ("began", "v", "begin"), ("kept", "v", "keep"), ("held", "v", "hold"), ("wrote", "v", "write"),
    ("written", "v", "write"), ("stood", "v", "stand"), ("heard", "v", "hear"), ("meant", "v", "mean"),
    ("ran", "v", "run"), ("running", "v", "run"), ("runs", "v", "run"), ("using", "v", "use"),
    ("used", "v", "use"), ("uses", "v", "use"),
    ("men", "n", "man"), ("women", "n", "woman"), ("children", "n", "child"), ("people", "n", "person"),
    ("feet", "n", "foot"), ("teeth", "n", "tooth"), ("mice", "n", "mouse"), ("geese", "n", "goose"),
    ("data", "n", "datum"), ("analyses", "n", "analysis"), ("texts", "n", "text"), ("words", "n", "word"),
    ("models", "n", "model"), ("years", "n", "year"), ("days", "n", "day"), ("things", "n", "thing"),
    ("better", "a", "good"), ("best", "a", "good"), ("worse", "a", "bad"), ("worst", "a", "bad"),
    ("larger", "a", "large"), ("largest", "a", "large"), ("smaller", "a", "small"),
    ("smallest", "a", "small"), ("bigger", "a", "big"), ("biggest", "a", "big"),
    ("better", "r", "well"), ("best", "r", "well"), ("faster", "r", "fast"), ("harder", "r", "hard"),
)

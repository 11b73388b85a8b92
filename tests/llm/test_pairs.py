import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from siftwarden.llm import pairs

FINDING = json.dumps({"finding": {"log_type": "okta", "signals": ["malware"], "summary": "The mail gateway dropped 14 records because nas-53 sent them out of order."}})
PROMPT = f"Write a short report for management. Keep it brief. Finding:\n{FINDING}\nuser=x dst=10.0.0.1"
GOOD = "The gateway dropped records. It was restarted and nothing else was lost."

CASES = [
    (None, "empty"), ("", "empty"), (" \n\t", "empty"), ("​", "empty"), ("```json\n```", "empty"), ('""', "empty"), ("null", "empty"), ("[]", "empty"), ('{"rationale": "", "ids": []}', "empty"), ('"{}"', "empty"), ("...", "empty"),
    (PROMPT, "copy"), ("Input: " + PROMPT, "copy"), (PROMPT.upper(), "copy"), ("> " + PROMPT.replace("\n", "\n> "), "copy"), (FINDING, "copy"), (json.dumps(json.loads(FINDING), indent=2), "copy"), (json.dumps({"answer": PROMPT}), "copy"), (f"```json\n{FINDING}\n```", "copy"),
    ("I'm sorry, but I can't help with that request.", "refusal"), ('{"error": "I must decline to answer."}', "refusal"), ("Als Sprachmodell kann ich dazu keine Einschätzung geben.", "refusal"), ("Désolé, je ne peux pas répondre à cette demande.", "refusal"), ("No me está permitido valorar este contenido.", "refusal"),
    ('{"a": 1, "b": [{"c": "text', "truncated"), ('```json\n{"a": "b"', "truncated"), ("The gateway dropped records. It was resta", "truncated"), ('{"a": "b",', "truncated"),
    ("Der Knoten wurde vom Netz genommen und die Regel ist noch nicht aktiv.", "other_language"), ('{"rationale": "O utilizador entrou a partir de outro nó e não foi bloqueado."}', "other_language"), ("メールゲートウェイは記録を落としました。確認してください。", "other_language"),
    (GOOD, None), (json.dumps({"rationale": GOOD}), None), (json.dumps({"is_anomaly": False, "x": None}), None), ('On "The mail gateway dropped 14 records because nas-53 sent them out of order.": ' + GOOD * 2, None),
    ("Sorry state of patching on nas-01: 3 items are open.", None), ("I recommend that the service desk decline the request of bot-1.", None), ("nas-1 cannot reach 10.0.0.1, so the agent is unable to report.", None),
    (f"```json\n{json.dumps({'a': GOOD})}\n```", None), ('{"risk_score": 3}', None),
]


@pytest.mark.parametrize(("raw", "want"), CASES)
def test_defects(raw, want):
    assert pairs.defect(PROMPT, raw) == want


def test_directive_names_the_language():
    assert pairs.defect("Ordne den Befund zu. Antworte auf Deutsch.\n" + FINDING, GOOD) == "other_language"
    assert pairs.defect("Ordne den Befund zu. Answer in English.\n" + FINDING, GOOD) is None


@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_automaton_against_brute_force(text, other):
    best = max((size for _, _, size in pairs.SuffixAutomaton(text).matches(other, 1)), default=0)
    want = max((j - i for i in range(len(other)) for j in range(i + 1, len(other) + 1) if other[i:j] in text), default=0)
    assert best == want
    for end, place, size in pairs.SuffixAutomaton(text).matches(other, 1):
        assert other[end - size : end] == text[place - size : place]


@given(st.text(max_size=80))
def test_any_answer_is_judged(raw):
    assert pairs.defect(PROMPT, raw) in (None, "empty", "copy", "refusal", "truncated", "other_language")


def test_long_answers():
    assert pairs.defect(PROMPT, GOOD * 20_000) is None
    assert pairs.defect(PROMPT, "[" * 100_000) in ("truncated", "empty")


def test_frame(spark):
    rows = [(1, PROMPT, "", " LLM", 0), (1, PROMPT, "", " LLM", 0), (2, PROMPT, "", "deterministic", 0), (3, " \n", "", "llm", 0), (4, None, "", "llm", 0), (5, PROMPT, GOOD, "Fallback", 0), (None, PROMPT, None, "fallback", 0), (6, PROMPT, "", None, 0)]
    df = spark.createDataFrame(rows, "result_id bigint, prompt string, raw string, source string, defect int")
    assert sorted(map(tuple, pairs.broken_pairs(df).collect()), key=str) == [(1, "empty"), (None, "empty")]
    assert pairs.broken_pairs(df.limit(0)).count() == 0


LONG = "The log shows several attempts from one address over a quarter of an hour. "


@pytest.mark.parametrize(
    "raw",
    [
        "“" + "x y " * 200 + "” I'm sorry, but I cannot help with that.",
        LONG * 9 + "I cannot assist with this request.",
        "Thank you for your question. It is a good one. I cannot help with that.",
        json.dumps({"severity": "low", "summary": "Two logins failed.", "rationale": "I cannot help with this request."}),
        json.dumps({"answer": "申し訳ありませんが、お答えできません。"}, ensure_ascii=False),
    ],
)
def test_refusals_are_found_wherever_they_stand(raw):
    assert pairs.defect('Assess the finding. Answer in English. {"a": 1}', raw) == "refusal"


def test_json_of_a_script_without_spaces_has_a_language():
    raw = json.dumps({"rationale": "送信元のアドレスは既知の不審な一覧に含まれています。"}, ensure_ascii=False)
    assert pairs.defect('Assess the finding. Answer in English. {"a": 1}', raw) == "other_language"
    assert pairs.defect('以下を日本語で評価してください。{"a": 1}', raw) is None


def test_bound_of_copies_drops_no_case():
    rng = random.Random(3)
    prompt = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(34 * 40))
    answer = "-" + "--".join(prompt[i : i + 34] for i in range(0, len(prompt), 34))
    assert pairs.copied_shares(prompt, answer)[1] == 1.0
    assert pairs.is_copy(prompt, [answer])
    for size in range(24, 60):
        spoilt = "-".join(prompt[i : i + size] for i in range(rng.randrange(12), len(prompt), size))
        assert pairs.is_copy(prompt, [spoilt]) == (max(pairs.copied_shares(prompt, spoilt)[1:]) >= 0.9)


def test_short_prompts_can_be_copied():
    assert pairs.defect("Score this alert.", "Score this alert.") == "copy"
    assert pairs.defect("Score this alert.", '{"answer": "score this alert."}') == "copy"
    assert pairs.defect("Score this alert.", "Score this alert: it is high, as two hosts are affected.") is None


def test_answers_of_any_depth_are_read():
    deep = '{"a": ' * 50_000 + '"I cannot help with this request."' + "}" * 50_000
    assert pairs.defect(PROMPT, deep) == "refusal"
    assert pairs.defect(PROMPT, '{"a": ' * 50_000 + "{}" + "}" * 50_000) == "empty"
    assert pairs.defect("Answer in English. " + '{"a":' * 50_000, GOOD) is None


def test_short_prose_has_a_language():
    ask = 'Assess the finding. Answer in English. {"a": 1}'
    assert pairs.defect(ask, '{"rationale": "CVE-2099-13011 sigue abierta en 4 nodos, sobre todo vpn-63."}') == "other_language"
    assert pairs.defect('Évaluez le constat. Répondez en français. {"a": 1}', "La technique T1199.006 correspond aux 107 événements de fw-edge89.") is None
    assert pairs.defect(ask, "CVE-2099-13011 open, vpn-63.") is None

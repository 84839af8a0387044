"""DuckDB SQL for the correctness check, one text per query of ``catalog``.

The SQL is written step by step from the semantics (regexes for rules, a
recursive walk with a visited list for roots, ranks for samples), on purpose in
another way than the Spark plans, so that agreement means something.
"""

from __future__ import annotations

from replyforge.functions import packs
from replyforge.functions.text import WHITESPACE, WHITESPACE_CLASS
from replyforge.plans.catalog import GIVEN_BIAS, GIVEN_LABELS, GIVEN_TERMS
from replyforge.plans.views import BRAND, GIVEN_BIASES, GIVEN_FEATURES, GIVEN_STEPS, PHRASES


def lit(value) -> str:
    """SQL string literal."""
    return "'" + str(value).replace("'", "''") + "'"


WS = "chr(" + ") || chr(".join(str(ord(c)) for c in WHITESPACE) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


MESSAGES = f"""
msgs AS (
  SELECT conv_id, turn, role,
    conv_id * 1000 + turn + 1 AS tweet_id,
    CASE role WHEN 'assistant' THEN 'brand' || CAST(conv_id % 5 AS VARCHAR)
              WHEN 'user' THEN 'user' || CAST(conv_id AS VARCHAR)
              ELSE 'system' END AS author_id,
    role <> 'assistant' AS inbound,
    CASE WHEN conv_id % 29 = 0 AND turn = 0 THEN 'bad'
         ELSE strftime(TIMESTAMP '2017-10-01 00:00:00' + to_hours(conv_id)
                       + to_minutes(turn * 7), '%Y-%m-%d %H:%M:%S') END AS created_at,
    text,
    CASE WHEN turn = 0 THEN NULL
         WHEN turn = 1 AND conv_id % 17 = 0 THEN NULL
         WHEN turn = 3 AND conv_id % 13 = 0 THEN conv_id * 1000 + turn + 1 + 900000000
         ELSE conv_id * 1000 + turn END AS in_response_to_tweet_id
  FROM conversations)"""

FULL = MESSAGES + """,
full_msgs AS (
  SELECT tweet_id, author_id, inbound, created_at, text,
    CASE WHEN lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) = turn + 1
         THEN CAST(tweet_id + 1 AS VARCHAR) END AS response_tweet_id,
    in_response_to_tweet_id
  FROM msgs)"""

EXTRACT = MESSAGES + f""",
ext AS (
  SELECT * FROM msgs
  WHERE (author_id = '{BRAND}' AND NOT inbound)
     OR tweet_id IN (SELECT in_response_to_tweet_id FROM msgs
                     WHERE author_id = '{BRAND}' AND NOT inbound
                       AND in_response_to_tweet_id IS NOT NULL))"""


def walk(source: str, starts: str) -> str:
    """Recursive parent walk over ``source`` from the ids in ``starts``."""
    return f"""
edges AS (
  SELECT m.tweet_id AS child, m.in_response_to_tweet_id AS parent FROM {source} m
  WHERE m.in_response_to_tweet_id IN (SELECT tweet_id FROM {source})),
walk(start, cur, depth, visited, stop) AS (
  SELECT s.id, s.id, 0, CAST([] AS BIGINT[]), FALSE FROM ({starts}) s(id)
  UNION ALL
  SELECT w.start, e.parent, w.depth + 1, list_append(w.visited, w.cur),
         list_contains(list_append(w.visited, w.cur), e.parent)
  FROM walk w JOIN edges e ON e.child = w.cur
  WHERE NOT w.stop AND w.depth < 20),
roots AS (SELECT start AS node, arg_max(cur, depth) AS root FROM walk GROUP BY start)"""


TURNS = EXTRACT + "," + walk(
    "ext", "SELECT DISTINCT in_response_to_tweet_id FROM ext WHERE in_response_to_tweet_id IS NOT NULL"
) + f""",
pairs AS (
  SELECT r.root AS conversation_id, m.tweet_id AS customer_tweet_id,
    m.author_id AS customer_author_id, m.text AS customer_text,
    m.created_at AS customer_created_at, s.tweet_id AS support_tweet_id,
    s.text AS support_text, s.created_at AS support_created_at
  FROM ext s JOIN ext m ON s.in_response_to_tweet_id = m.tweet_id
  JOIN roots r ON r.node = m.tweet_id
  WHERE s.author_id = '{BRAND}'),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY support_tweet_id) AS turn_index,
    count(*) OVER (PARTITION BY conversation_id) AS conversation_turns
  FROM pairs)"""

DIRTY = MESSAGES + """,
dirty_base AS (
  SELECT * EXCLUDE (text),
    CASE WHEN conv_id % 23 = 0 AND turn = 5 THEN NULL
         WHEN conv_id % 11 = 3 AND turn = 3 THEN '   '
         WHEN conv_id % 11 = 5 AND turn = 1 THEN 'DM us'
         WHEN conv_id % 7 = 0 AND turn = 1 THEN repeat(text, 12)
         ELSE text END AS text
  FROM msgs),
dirty AS (
  SELECT *, 0 AS copy FROM dirty_base
  UNION ALL SELECT *, 1 AS copy FROM dirty_base WHERE conv_id % 19 = 0)"""

DIRTY_PAIRS = DIRTY + """,
dpairs AS (
  SELECT s.conv_id AS conversation_id, m.tweet_id AS customer_tweet_id,
    m.author_id AS customer_author_id, m.text AS customer_text,
    m.created_at AS customer_created_at, s.tweet_id AS support_tweet_id,
    s.text AS support_text, s.created_at AS support_created_at
  FROM dirty s JOIN dirty m ON s.copy = m.copy AND s.in_response_to_tweet_id = m.tweet_id
  WHERE s.role = 'assistant')"""

STEPPED = DIRTY_PAIRS + f""",
stepped AS (
  SELECT *, CASE
    WHEN customer_text IS NULL OR support_text IS NULL THEN 'null_text'
    WHEN {strip('customer_text')} = '' OR {strip('support_text')} = '' THEN 'whitespace'
    WHEN length({strip('support_text')}) < 10 THEN 'too_short_support' END AS step,
    row_number() OVER (PARTITION BY customer_tweet_id, support_tweet_id,
      (customer_text IS NULL OR support_text IS NULL)) AS nth
  FROM dpairs)"""

CLEAN = STEPPED + """,
kept AS (
  SELECT conversation_id, customer_tweet_id, customer_author_id, customer_text,
    customer_created_at, support_tweet_id, support_text, support_created_at,
    length(support_text) AS support_text_len, length(support_text) > 560 AS is_long_response
  FROM stepped WHERE step IS NULL
  QUALIFY row_number() OVER (PARTITION BY customer_tweet_id, support_tweet_id
                             ORDER BY customer_text, support_text) = 1),
clean AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY support_tweet_id) AS turn_index,
    count(*) OVER (PARTITION BY conversation_id) AS conversation_turns
  FROM kept),
conv_lengths AS (
  SELECT conversation_id, max(conversation_turns) AS turns FROM clean GROUP BY 1)"""

SPIKED = MESSAGES + f""",
spiked AS (
  SELECT conv_id, turn, tweet_id AS customer_tweet_id,
    'M' || CAST(tweet_id AS VARCHAR) AS example_id,
    text || ' ' || ([{', '.join(lit(p) for p in PHRASES)}])[CAST((conv_id * 7 + turn) % {len(PHRASES)} + 1 AS INTEGER)]
      AS customer_text
  FROM msgs)"""


def hit_list(text: str, pack: dict) -> str:
    """SQL list of the intents whose patterns are found, in pack order."""
    marks = ", ".join(
        "CASE WHEN " + " OR ".join(f"regexp_matches({text}, {lit(p)})" for p in pats)
        + f" THEN {lit(name)} END"
        for name, pats in pack.items()
    )
    return f"list_filter([{marks}], lambda x: x IS NOT NULL)"


WEAK = SPIKED + f""",
weak_hits AS (
  SELECT *, {hit_list('lower(customer_text)', packs.WEAK_RULES)} AS h FROM spiked),
weak AS (
  SELECT * EXCLUDE (h),
    CASE WHEN len(h) = 0 THEN 'other_unknown' ELSE h[1] END AS intent,
    CAST(CASE len(h) WHEN 0 THEN 0.8 WHEN 1 THEN 0.9 ELSE 0.6 END AS DOUBLE) AS confidence,
    CASE len(h) WHEN 0 THEN {lit(packs.WEAK_NONE[1])} WHEN 1 THEN {lit(packs.WEAK_SINGLE[1])}
      ELSE {lit(packs.WEAK_CONFLICT[1])} END AS labeling_method
  FROM weak_hits)"""

AUTO = """
auto_hits AS (
  SELECT *, {hits} AS h FROM spiked),
auto_cases AS (
  SELECT *, list_filter(h, lambda x: x <> 'customer_service_escalation') AS act,
    CASE WHEN len(h) = 0 THEN 0 WHEN len(h) = 1 THEN 1
      WHEN list_contains(h, 'delivery_issue') AND list_contains(h, 'refund_return') THEN 2
      WHEN list_contains(h, 'refund_return') AND list_contains(h, 'product_defect') THEN 3
      WHEN list_contains(h, 'order_status_tracking') AND list_contains(h, 'delivery_issue') THEN 4
      WHEN list_contains(h, 'customer_service_escalation') THEN 5 ELSE 6 END AS k
  FROM auto_hits),
auto AS (
  SELECT conv_id, turn, customer_tweet_id, example_id, customer_text,
    CASE k WHEN 0 THEN 'other_unknown' WHEN 2 THEN 'delivery_issue' WHEN 3 THEN 'product_defect'
      WHEN 4 THEN 'delivery_issue' WHEN 5 THEN act[1] ELSE h[1] END AS intent,
    CASE WHEN k IN (0, 6) THEN 'hard' WHEN k = 1 THEN 'easy' ELSE 'medium' END AS difficulty,
    CASE k WHEN 0 THEN {none} WHEN 1 THEN 'Matched single rule for ' || h[1] || '.'
      WHEN 2 THEN {n2} WHEN 3 THEN {n3} WHEN 4 THEN {n4}
      WHEN 5 THEN 'Matched ' || act[1] || ' and escalation. Prioritizing actionable issue.'
      ELSE 'Multiple overlapping matches (' || array_to_string(h, ', ') || '). Chose first match.'
    END AS labeling_notes
  FROM auto_cases)""".format(
    hits=hit_list("lower(customer_text)", packs.GOLDEN_RULES),
    none=lit(packs.NOTE_NONE), n2=lit(packs.NOTE_DELIVERY_REFUND),
    n3=lit(packs.NOTE_DEFECT_REFUND), n4=lit(packs.NOTE_TRACKING_DELIVERY),
)
GOLDEN = SPIKED + "," + AUTO


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


KEYWORD_CASE = "CASE " + " ".join(
    f"WHEN {any_of('lower(customer_text)', words)} THEN {lit(name)}"
    for name, words in packs.KEYWORD_RULES.items()
) + " ELSE 'other_unknown' END"

ROUTED = WEAK + f""",
model AS (
  SELECT conv_id, turn, customer_tweet_id, example_id, customer_text, intent AS model_intent,
    ((conv_id * 7 + turn * 13) % 200) / 200.0::DOUBLE AS confidence,
    {strip('lower(customer_text)')} AS low
  FROM weak),
over AS (
  SELECT *,
    CASE WHEN {any_of('low', packs.LOSS_WORDS)} THEN 'loss'
         WHEN {any_of('low', packs.HUMAN_WORDS)} THEN 'human'
         WHEN {any_of('low', packs.ACCOUNT_WORDS)} THEN 'account'
         WHEN low IN ({', '.join(lit(g) for g in packs.GREETINGS)}) THEN 'greet'
         ELSE 'none' END AS rule
  FROM model),
routed AS (
  SELECT * EXCLUDE (rule, low),
    CASE rule WHEN 'loss' THEN 'delivery_issue' WHEN 'human' THEN 'customer_service_escalation'
      WHEN 'account' THEN 'account_billing' WHEN 'greet' THEN 'other_unknown'
      ELSE model_intent END AS intent,
    CASE rule WHEN 'human' THEN {lit(packs.REASON_HUMAN)}
      WHEN 'account' THEN {lit(packs.REASON_ACCOUNT)} ELSE '' END AS override_reason
  FROM over),
decided AS (
  SELECT *,
    confidence < 0.6 OR intent IN ('customer_service_escalation', 'other_unknown')
      OR contains(override_reason, 'Sensitive') AS needs_escalation,
    CASE WHEN confidence < 0.6
           THEN 'Low intent confidence: ' || CAST(CAST(round_even(confidence * 100, 0) AS INTEGER) AS VARCHAR) || '%'
         WHEN intent = 'customer_service_escalation' AND override_reason <> '' THEN override_reason
         WHEN intent = 'customer_service_escalation' THEN {lit(packs.REASON_ESCALATION)}
         WHEN intent = 'other_unknown' THEN {lit(packs.REASON_OTHER)}
         WHEN contains(override_reason, 'Sensitive') THEN override_reason
         ELSE {lit(packs.REASON_NONE)} END AS escalation_reason
  FROM routed)"""

PREDS = ROUTED + "," + AUTO + f""",
preds AS (
  SELECT d.example_id, d.customer_tweet_id, d.customer_text, a.intent AS true_intent,
    d.intent AS predicted_intent, d.confidence, a.intent = d.intent AS correct,
    CASE WHEN a.intent IN ('customer_service_escalation', 'other_unknown') THEN 1
         WHEN {any_of(strip('lower(d.customer_text)'), ["stolen", "missing", "lost", "human", "agent", "real person", "access my account"])} THEN 1
         ELSE 0 END AS expected_escalation,
    CAST(d.needs_escalation AS INTEGER) AS predicted_escalation
  FROM decided d JOIN auto a USING (customer_tweet_id))"""


def report(pred: str, name: str = "rep") -> str:
    """CTE of per-label scores for one prediction column of ``named``."""
    return f"""
{name}_labels AS (SELECT true_intent AS label FROM named UNION SELECT {pred} FROM named),
{name}_counts AS (
  SELECT label,
    (SELECT count(*) FROM named WHERE true_intent = label AND {pred} = label) AS tp,
    (SELECT count(*) FROM named WHERE {pred} = label) AS np,
    (SELECT count(*) FROM named WHERE true_intent = label) AS support
  FROM {name}_labels),
{name}_pr AS (
  SELECT label, support, tp,
    CASE WHEN np = 0 THEN 0 ELSE tp::DOUBLE / np END AS precision,
    CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS recall
  FROM {name}_counts),
{name} AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0
    ELSE 2 * precision * recall / (precision + recall) END AS f1
  FROM {name}_pr)"""


PATCHY = PREDS + """, patchy AS (
  SELECT * REPLACE (
    CASE WHEN customer_tweet_id % 7 <> 3 THEN predicted_intent END AS predicted_intent,
    CASE WHEN customer_tweet_id % 11 <> 5 THEN true_intent END AS true_intent,
    CASE WHEN customer_tweet_id % 7 <> 3 THEN predicted_escalation END AS predicted_escalation)
  FROM preds)"""
NAMED = PREDS + ", named AS (SELECT * FROM preds)"
DIM_ROWS = ", ".join(
    "(" + ", ".join(
        lit(v) for v in (name, *packs.DIMENSION[name], packs.EVIDENCE[name], packs.REPLIES[name])
    ) + ")"
    for name in packs.ALL_INTENTS
)
DIM = f"""
dim(d_intent, label, priority, department, action, evidence, reply) AS (VALUES {DIM_ROWS})"""


def dimmed(source: str, intent: str) -> str:
    return (
        f"(SELECT s.*, dim.* FROM {source} s JOIN dim "
        f"ON dim.d_intent = CASE WHEN s.{intent} IN (SELECT d_intent FROM dim) "
        f"THEN s.{intent} ELSE 'other_unknown' END)"
    )


def prompt(template: str, **values: str) -> str:
    """The template with ``{slot}`` parts as a SQL concatenation."""
    text = template
    for name in values:
        text = text.replace("{" + name + "}", f"\0{name}\0")
    pieces = text.replace("{{", "{").replace("}}", "}").split("\0")
    return " || ".join(
        values[p] if i % 2 else lit(p) for i, p in enumerate(pieces) if i % 2 or p
    )


JUDGED = PREDS + "," + DIM + f""",
sampled AS (
  SELECT * FROM preds ORDER BY md5('42:' || example_id), example_id LIMIT 25),
judged AS (
  SELECT example_id, customer_text AS customer_message, true_intent AS expected_intent,
    predicted_intent, confidence, evidence AS retrieved_evidence, reply AS generated_reply,
    {lit(packs.REPLY_MODE)} AS reply_mode,
    CASE WHEN predicted_intent = true_intent THEN 5 ELSE 2 END::BIGINT AS judge_intent_score,
    CASE WHEN length(reply) > 20 THEN 4 ELSE 2 END::BIGINT AS judge_relevance_score,
    CASE WHEN length(reply) > 20 THEN 5 ELSE 3 END::BIGINT AS judge_grounding_score,
    CASE WHEN length(reply) > 20 THEN 4 ELSE 2 END::BIGINT AS judge_helpfulness_score,
    5::BIGINT AS judge_safety_score,
    {lit(packs.JUDGE_REASON)} AS judge_reason
  FROM {dimmed('sampled', 'predicted_intent')}),
judge AS (
  SELECT *, CAST(floor((judge_intent_score + judge_relevance_score + judge_grounding_score
    + judge_helpfulness_score + judge_safety_score) / 5.0) AS BIGINT) AS judge_overall_score
  FROM judged)"""

JUDGE_ALL = PREDS + "," + DIRTY.replace(MESSAGES + ",", "", 1) + """,
answers AS (
  SELECT p.*, coalesce(d.text, '') AS reply FROM preds p
  JOIN dirty d ON d.tweet_id = p.customer_tweet_id AND d.copy = 0),
part AS (
  SELECT *, CASE WHEN predicted_intent = true_intent THEN 5 ELSE 2 END::BIGINT AS judge_intent_score,
    CASE WHEN length(reply) > 20 THEN 4 ELSE 2 END::BIGINT AS judge_relevance_score,
    CASE WHEN length(reply) > 20 OR contains(reply, 'Template fallback') THEN 5 ELSE 3 END::BIGINT
      AS judge_grounding_score,
    CASE WHEN length(reply) > 20 THEN 4 ELSE 2 END::BIGINT AS judge_helpfulness_score,
    5::BIGINT AS judge_safety_score
  FROM answers),
judge AS (
  SELECT *, CAST(floor((judge_intent_score + judge_relevance_score + judge_grounding_score
    + judge_helpfulness_score + judge_safety_score) / 5.0) AS BIGINT) AS judge_overall_score
  FROM part)"""

REVIEW = GOLDEN + f""",
flags AS (
  SELECT example_id, ([{', '.join(lit(i) for i in packs.INTENTS)}])[CAST(conv_id % 7 + 1 AS INTEGER)]
      AS suggested_intent,
    CASE WHEN (conv_id * 5 + turn) % 12 = 0 THEN 'wrong phrase'
      WHEN (conv_id * 5 + turn) % 12 < 3 THEN 'wrong product' ELSE '' END AS reason_for_review,
    CASE (conv_id * 5 + turn) % 12 WHEN 0 THEN 'accept' WHEN 1 THEN ' Accept' || chr(9)
      WHEN 2 THEN 'reject' ELSE '' END AS human_decision
  FROM spiked)"""

DISCOVERY_STOPS = ", ".join(lit(w) for w in sorted(set(packs.DISCOVERY_STOP_WORDS)))
REPORT_STOPS = ", ".join(lit(w) for w in sorted(set(packs.REPORT_STOP_WORDS)))

# The cleaner step by step: mentions, links, non-letters, single letters, blanks.
_c = "regexp_replace(lower(text), '@[a-z0-9_]+', '', 'g')"
_c = f"regexp_replace({_c}, 'http[^{WHITESPACE_CLASS}]+', '', 'g')"
_c = f"regexp_replace({_c}, '[^a-z{WHITESPACE_CLASS}]', ' ', 'g')"
_c = f"regexp_replace({_c}, '\\b[a-z]\\b', '', 'g')"
_c = f"regexp_replace({_c}, '[{WHITESPACE_CLASS}]+', ' ', 'g')"
CLEANED = f"""
cleaned AS (SELECT doc_id, text, trim({_c}, ' ') AS clean_text FROM documents),
topic_words AS (
  SELECT doc_id, list_filter(regexp_extract_all(clean_text, '[\\p{{L}}\\p{{N}}_]{{2,}}'),
    lambda w: w NOT IN ({DISCOVERY_STOPS})) AS w FROM cleaned)"""


def gram(n: int) -> str:
    word = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
    return f"list_transform(range(1, len(w) - {n - 2}), lambda i: {word})"


TRAIN_TERMS = f"""
word_lists AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM documents),
terms AS (
  SELECT doc_id, unnest(list_concat(w, {gram(2)})) AS term FROM word_lists),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
vocab AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term
  HAVING count(*) >= 2)"""


def weights(vocab: str, tf: str) -> str:
    return f"""
raw AS (
  SELECT doc_id, term,
    {tf} * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS raw
  FROM tf JOIN {vocab} USING (term))
SELECT doc_id, term,
  round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw"""


def top_grams(n: int) -> str:
    return f"""WITH {CLEANED}, grams AS (
  SELECT unnest({gram(n)}) AS ngram FROM topic_words)
SELECT ngram, count(*) AS n FROM grams GROUP BY ngram ORDER BY n DESC, ngram LIMIT 20"""


def chain(cycles: bool) -> str:
    turned = "event_id % 50 = 0" if cycles else "FALSE"
    return f"""WITH RECURSIVE chain AS (
  SELECT event_id AS tweet_id,
    CASE WHEN {turned} THEN event_id + 3
         WHEN event_id - 1 - user_id % 3 >= 0 THEN event_id - 1 - user_id % 3 END
      AS in_response_to_tweet_id
  FROM events), {walk('chain', 'SELECT tweet_id FROM chain')}
SELECT node, root FROM roots WHERE node IN (SELECT child FROM edges)"""


GOLD_DOCS = """
docs AS (SELECT doc_id, text, length(text) AS text_len FROM documents),
edges AS (
  SELECT round(quantile_cont(text_len, 1.0 / 3), 9) AS e1,
         round(quantile_cont(text_len, 2.0 / 3), 9) AS e2 FROM docs),
binned AS (
  SELECT docs.*, CASE WHEN text_len <= e1 THEN 'short' WHEN text_len <= e2 THEN 'medium'
    ELSE 'long' END AS len_bin FROM docs, edges),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY len_bin
    ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS nth FROM binned),
tiers AS (
  SELECT *, row_number() OVER (ORDER BY CASE WHEN nth <= 83 THEN 0 ELSE 1 END,
    md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS seat FROM ranked),
gold AS (
  SELECT 'GS-' || CASE WHEN pos < 1000 THEN lpad(CAST(pos AS VARCHAR), 3, '0') ELSE CAST(pos AS VARCHAR) END
      AS example_id,
    doc_id AS customer_tweet_id, text AS customer_text, 'UNLABELED' AS intent,
    '' AS labeling_notes, doc_id AS source_conversation_id, '' AS difficulty, text_len, len_bin
  FROM (SELECT *, row_number() OVER (
          ORDER BY md5('42:shuffle:' || CAST(doc_id AS VARCHAR)), doc_id) AS pos
        FROM tiers WHERE seat <= 250))"""


def split(source: str) -> str:
    """CTEs of a stratified 90/10 split of ``source``."""
    return f"""
classes AS (SELECT intent, count(*) AS n, sum(count(*)) OVER () AS total FROM {source} GROUP BY intent),
seats AS (
  SELECT *, total - ceil(total / 10.0) AS keep,
    n * (total - ceil(total / 10.0)) / total::DOUBLE AS exact FROM classes),
seated AS (
  SELECT intent, n, floor(exact) + CASE WHEN row_number() OVER (
      ORDER BY round(exact - floor(exact), 9) DESC, intent)
      <= keep - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS train_n FROM seats),
split_rows AS (
  SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.intent
      ORDER BY md5('42:' || CAST(s.customer_tweet_id AS VARCHAR)), s.customer_tweet_id)
      <= seated.n - seated.train_n THEN 'val' ELSE 'train' END AS split
  FROM {source} s JOIN seated USING (intent))"""


def balanced(source: str) -> str:
    return f"""
ranked_other AS (
  SELECT *, row_number() OVER (PARTITION BY intent
    ORDER BY md5('42:' || CAST(customer_tweet_id AS VARCHAR)), customer_tweet_id) AS nth FROM {source}),
balanced AS (
  SELECT * EXCLUDE (nth) FROM ranked_other
  WHERE intent <> 'other_unknown'
     OR nth <= (SELECT count(*) FROM {source} WHERE intent <> 'other_unknown'))"""


HELD_OUT = """
held AS (
  SELECT customer_tweet_id, customer_text FROM spiked
  ORDER BY md5('42:' || CAST(customer_tweet_id AS VARCHAR)), customer_tweet_id LIMIT 250)"""

ROUTE_SQL = f"""WITH {ROUTED}, {DIM}
SELECT example_id, CAST(json_object(
    'customer_message', customer_text,
    'predictions', json_object('intent', intent, 'confidence', confidence, 'priority', priority,
      'needs_human_escalation', needs_escalation, 'escalation_reason', escalation_reason),
    'routing', json_object('assigned_department', department),
    'suggested_action', action,
    'reply_generation', json_object('draft_reply', reply,
      'generation_mode', {lit(packs.REPLY_MODE)}, 'evidence_used', evidence)) AS VARCHAR) AS response
FROM {dimmed('decided', 'intent')} WHERE {strip('customer_text')} <> ''"""

# The given model: terms with idf and hashed coefficients; margins, probabilities.
_EIGHT = range(len(packs.ALL_INTENTS))
_INTENT_LIST = ", ".join(lit(i) for i in packs.ALL_INTENTS)
GIVEN = f"""
gm_words AS (
  SELECT customer_tweet_id, regexp_extract_all(lower(customer_text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w
  FROM spiked),
gm_tf AS (
  SELECT customer_tweet_id, term, count(*) AS tf FROM (
    SELECT customer_tweet_id, unnest(list_concat(w, {gram(2)})) AS term FROM gm_words) GROUP BY ALL),
gm_vocab AS (
  SELECT term, count(*) AS df, sum(tf) AS cf FROM gm_tf GROUP BY term HAVING count(*) >= 2
  ORDER BY cf DESC, term LIMIT {GIVEN_FEATURES}),
gm AS (
  SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM spiked)) / (1 + df)) + 1 AS idf,
    [{', '.join(
        f"(('0x' || substr(md5(term || {lit(':' + i)}), 1, 6))::INTEGER % 2001 - 1000) / {GIVEN_STEPS}::DOUBLE"
        for i in packs.ALL_INTENTS)}] AS c
  FROM gm_vocab),
gm_raw AS (
  SELECT customer_tweet_id, term, (1 + ln(tf)) * idf AS raw, c FROM gm_tf JOIN gm USING (term)),
gm_x AS (
  SELECT customer_tweet_id, term, c,
    raw / sqrt(sum(raw * raw) OVER (PARTITION BY customer_tweet_id)) AS x FROM gm_raw),
gm_dots AS (
  SELECT customer_tweet_id, [{', '.join(f'sum(x * c[{i + 1}])' for i in _EIGHT)}] AS d
  FROM gm_x GROUP BY 1),
gm_margins AS (
  SELECT s.*, [{', '.join(f'{b}::DOUBLE + coalesce(d[{i + 1}], 0)' for i, b in enumerate(GIVEN_BIASES))}] AS z
  FROM spiked s LEFT JOIN gm_dots USING (customer_tweet_id)),
scored AS (
  SELECT * EXCLUDE (z), z, ([{_INTENT_LIST}])[list_position(z, list_max(z))] AS model_intent,
    1.0 / list_sum(list_transform(z, lambda v: exp(v - list_max(z)))) AS full_confidence
  FROM gm_margins)"""

ROUTED_GIVEN = SPIKED + "," + GIVEN + f""",
model AS (
  SELECT conv_id, turn, customer_tweet_id, example_id, customer_text, model_intent,
    round(full_confidence, 4) AS confidence, {strip('lower(customer_text)')} AS low
  FROM scored),
over AS (""" + ROUTED.split("over AS (", 1)[1]

# Residual of every (row, class), summed per (term, class), plus the penalty.
GRADIENT = f"""WITH {WEAK}, {GIVEN},
sizes AS (SELECT intent, count(*) AS support FROM weak WHERE customer_text IS NOT NULL GROUP BY 1),
n AS (SELECT sum(support)::DOUBLE AS n, count(*) AS k FROM sizes),
residuals AS (
  SELECT customer_tweet_id, [{', '.join(
      f"(n / (k * support)) / n * (e[{i + 1}] / list_sum(e) - (intent = {lit(name)})::INTEGER)"
      for i, name in enumerate(packs.ALL_INTENTS))}] AS r
  FROM (SELECT customer_tweet_id, list_transform(z, lambda v: exp(v - list_max(z))) AS e
        FROM scored WHERE customer_text IS NOT NULL)
    JOIN weak USING (customer_tweet_id) JOIN sizes USING (intent), n),
slopes AS (
  SELECT term, [{', '.join(f'sum(x * r[{i + 1}])' for i in _EIGHT)}] AS g
  FROM gm_x JOIN residuals USING (customer_tweet_id) GROUP BY term),
lines AS (
  SELECT term, [{', '.join(f'coalesce(g[{i + 1}], 0) + c[{i + 1}] / n' for i in _EIGHT)}] AS g
  FROM gm LEFT JOIN slopes USING (term), n
  UNION ALL SELECT '(bias)', [{', '.join(f'sum(r[{i + 1}])' for i in _EIGHT)}] FROM residuals)
SELECT term, unnest([{_INTENT_LIST}]) AS label,
  unnest(list_transform(g, lambda v: round(v, 9))) AS gradient FROM lines"""

# One k-means round on sparse rows: centres of the given clusters, nearest centre.
LLOYD = f"""{CLEANED},
terms AS (SELECT doc_id, unnest(w) AS term FROM topic_words),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
vocab AS (
  SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 2000),
raw AS (
  SELECT doc_id, term,
    tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS raw
  FROM tf JOIN vocab USING (term)),
x AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS x FROM raw),
start AS (SELECT doc_id, (doc_id % 10)::INTEGER AS cluster FROM cleaned WHERE clean_text <> ''),
first_centres AS (
  SELECT cluster, term, sum(x) / any_value(size) AS w
  FROM x JOIN start USING (doc_id)
    JOIN (SELECT cluster, count(*) AS size FROM start GROUP BY 1) USING (cluster) GROUP BY ALL),
squares AS (SELECT cluster, sum(w * w) AS n FROM first_centres GROUP BY 1),
dots AS (
  SELECT doc_id, cluster, sum(x * w) AS d FROM x JOIN first_centres USING (term) GROUP BY ALL),
far AS (
  SELECT s.doc_id, q.cluster, q.n - 2 * coalesce(d, 0) AS far
  FROM start s CROSS JOIN squares q LEFT JOIN dots ON dots.doc_id = s.doc_id AND dots.cluster = q.cluster),
assigned AS (
  SELECT doc_id, arg_min(cluster, (far, cluster)) AS cluster FROM far GROUP BY doc_id)"""

MODEL_ROWS = PREDS + f""",
majority AS (
  SELECT intent FROM weak GROUP BY intent ORDER BY count(*) DESC, intent LIMIT 1),
named AS (
  SELECT preds.*, (SELECT intent FROM majority) AS maj, {KEYWORD_CASE} AS keyword FROM preds)"""


def model_row(name: str, cte: str) -> str:
    return f"""SELECT {lit(name)} AS model, round(sum(tp)::DOUBLE / sum(support), 9) AS accuracy,
  round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1
FROM {cte}"""


_PCT_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, "
    f"round(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*), 6) AS null_pct FROM full_msgs"
    for c in ("tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id",
              "in_response_to_tweet_id")
)

_BRANDS = """
brands AS (SELECT author_id, count(*) AS outbound_messages FROM msgs WHERE NOT inbound GROUP BY 1),
ranked_brands AS (
  SELECT row_number() OVER (ORDER BY outbound_messages DESC, author_id) AS rank, * FROM brands)"""

_STATS = " UNION ALL ".join(
    f"SELECT '{s}' AS side, round(avg(length({s}_text)), 6) AS mean_len, "
    f"quantile_cont(length({s}_text), 0.5) AS median_len, max(length({s}_text)) AS max_len FROM clean"
    for s in ("customer", "support")
)

def given_score() -> str:
    """Scores of the given model: terms of a text, unit length, softmax."""
    k = range(len(GIVEN_LABELS))
    values = ", ".join(
        f"({lit(t)}, {idf}::DOUBLE, " + ", ".join(f"{c}::DOUBLE" for c in cs) + ")"
        for t, idf, cs in GIVEN_TERMS
    )
    names = ", ".join(f"c{i}" for i in k)
    z = ", ".join(f"{GIVEN_BIAS[i]} + coalesce(d{i} / sqrt(nn), 0) AS z{i}" for i in k)
    top = "greatest(" + ", ".join(f"z{i}" for i in k) + ")"
    cases = " ".join(f"WHEN z{i} = {top} THEN {lit(GIVEN_LABELS[i])}" for i in k)
    return f"""WITH {SPIKED},
w AS (SELECT customer_tweet_id, regexp_extract_all(lower(customer_text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS ws
  FROM spiked),
g AS (SELECT customer_tweet_id, unnest(list_concat(ws,
  list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
tf AS (SELECT customer_tweet_id, term, count(*) AS n FROM g GROUP BY 1, 2),
t(term, idf, {names}) AS (VALUES {values}),
s AS (SELECT customer_tweet_id, sum(raw * raw) AS nn, {', '.join(f'sum(raw * c{i}) AS d{i}' for i in k)}
  FROM (SELECT customer_tweet_id, (1 + ln(n)) * idf AS raw, {names} FROM tf JOIN t USING (term))
  GROUP BY 1),
z AS (SELECT customer_tweet_id, {z} FROM spiked LEFT JOIN s USING (customer_tweet_id))
SELECT customer_tweet_id, CASE {cases} END AS model_intent,
  round(1 / ({' + '.join(f'exp(z{i} - {top})' for i in k)}), 6) AS confidence FROM z"""


SQL: dict[str, str] = {
    "extract_brand": f"""WITH {EXTRACT}
SELECT tweet_id, author_id, inbound, created_at, text, in_response_to_tweet_id FROM ext""",
    "pair_replies": f"""WITH {MESSAGES}
SELECT m.tweet_id AS customer_tweet_id, m.author_id AS customer_author_id,
  m.text AS customer_text, m.created_at AS customer_created_at,
  s.tweet_id AS support_tweet_id, s.text AS support_text, s.created_at AS support_created_at
FROM msgs s JOIN msgs m ON s.in_response_to_tweet_id = m.tweet_id WHERE NOT s.inbound""",
    "conversation_roots": f"""WITH RECURSIVE {MESSAGES}, {walk('msgs', 'SELECT tweet_id FROM msgs')}
SELECT node, root FROM roots WHERE node IN (SELECT child FROM edges)""",
    "roots_with_copies": f"""WITH RECURSIVE {MESSAGES}, {walk('msgs', 'SELECT tweet_id FROM msgs')}
SELECT node, root FROM roots WHERE node IN (SELECT child FROM edges)""",
    "turn_index": f"WITH RECURSIVE {TURNS} SELECT * FROM turns",
    "turn_histogram": f"""WITH RECURSIVE {TURNS},
c AS (SELECT conversation_id, count(*) AS turns FROM turns GROUP BY 1)
SELECT turns, count(*) AS conversations,
  round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM c), 6) AS pct FROM c GROUP BY turns""",
    "skip_accounting": f"""WITH {MESSAGES}
SELECT count(*) AS replies,
  count(*) FILTER (s.in_response_to_tweet_id IN (SELECT tweet_id FROM msgs)) AS paired,
  count(*) FILTER (s.in_response_to_tweet_id IS NULL) AS no_parent,
  count(*) FILTER (s.in_response_to_tweet_id IS NOT NULL
    AND s.in_response_to_tweet_id NOT IN (SELECT tweet_id FROM msgs)) AS parent_missing
FROM msgs s WHERE NOT inbound""",
    "orphan_replies": f"""WITH {MESSAGES}
SELECT tweet_id, author_id, in_response_to_tweet_id FROM msgs
WHERE NOT inbound AND in_response_to_tweet_id IS NOT NULL
  AND in_response_to_tweet_id NOT IN (SELECT tweet_id FROM msgs)""",
    "root_depth_cap": chain(False),
    "root_cycles": chain(True),
    "clean_pairs": f"WITH {CLEAN} SELECT * FROM clean",
    "clean_ledger": f"""WITH {STEPPED},
totals AS (
  SELECT count(*) AS n, count(*) FILTER (step = 'null_text') AS s1,
    count(*) FILTER (step = 'whitespace') AS s2,
    count(*) FILTER (step = 'too_short_support') AS s3,
    count(*) FILTER (step IS NULL) - (SELECT count(*) FROM (
      SELECT DISTINCT customer_tweet_id, support_tweet_id FROM stepped WHERE step IS NULL)) AS s4
  FROM stepped),
lines(step_no, step, removed, reason) AS (
  SELECT 1::BIGINT, 'null_text', s1, 'customer_text or support_text is NULL' FROM totals
  UNION ALL SELECT 2, 'whitespace', s2, 'customer or support text is whitespace-only' FROM totals
  UNION ALL SELECT 3, 'too_short_support', s3, 'support_text has fewer than 10 characters' FROM totals
  UNION ALL SELECT 4, 'duplicate_pairs', s4, 'duplicate (customer_tweet_id, support_tweet_id) pair'
    FROM totals)
SELECT *, round(removed * 100.0::DOUBLE / (SELECT n FROM totals), 6) AS removed_pct FROM lines""",
    "short_reply_topk": f"""WITH {STEPPED}
SELECT support_text, count(*) AS n FROM stepped WHERE step = 'too_short_support'
GROUP BY 1 ORDER BY n DESC, support_text LIMIT 10""",
    "dedup_pairs": f"""WITH {DIRTY_PAIRS}
SELECT DISTINCT customer_tweet_id, support_tweet_id, customer_text, support_text FROM dpairs""",
    "long_flag": f"""WITH {DIRTY_PAIRS}
SELECT length(support_text) > 560 AS is_long_response, count(*) AS n FROM dpairs GROUP BY 1""",
    "blank_split": f"""WITH {DIRTY}
SELECT CASE WHEN text IS NULL THEN 'null' WHEN {strip('text')} = '' THEN 'blank' ELSE 'scored' END AS fate,
  count(*) AS n, CAST(sum(length({strip('text')})) AS BIGINT) AS stripped_chars FROM dirty GROUP BY 1""",
    "null_profile": f"WITH {FULL} {_PCT_NULLS}",
    "missing_values": f"""WITH {FULL}, np AS ({_PCT_NULLS})
SELECT "column", n_rows, n_null, FALSE AS has_label FROM np WHERE n_null > 0""",
    "direction_counts": f"""WITH {MESSAGES}
SELECT 'inbound' AS direction, count(*) FILTER (inbound) AS n,
  round(count(*) FILTER (inbound) * 100.0::DOUBLE / count(*), 6) AS pct FROM msgs
UNION ALL SELECT 'outbound', count(*) FILTER (NOT inbound),
  round(count(*) FILTER (NOT inbound) * 100.0::DOUBLE / count(*), 6) FROM msgs
UNION ALL SELECT 'unknown', count(*) FILTER (inbound IS NULL),
  round(count(*) FILTER (inbound IS NULL) * 100.0::DOUBLE / count(*), 6) FROM msgs""",
    "duplicate_ids": f"""WITH {DIRTY}, c AS (SELECT tweet_id, count(*) AS n FROM dirty GROUP BY 1)
SELECT count(*) AS unique_ids, count(*) FILTER (n > 1) AS duplicated_ids,
  CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM c""",
    "author_counts": f"""WITH {MESSAGES}
SELECT author_id, count(*) FILTER (NOT inbound) AS outbound_messages,
  count(*) AS total_author_msgs FROM msgs GROUP BY 1""",
    "top_brands": f"""WITH {MESSAGES}, {_BRANDS}
SELECT rank, author_id, outbound_messages,
  round(outbound_messages * 100.0::DOUBLE / (SELECT count(*) FROM msgs), 6) AS pct_of_rows
FROM ranked_brands WHERE rank <= 15""",
    "brand_recommendation": f"""WITH {MESSAGES}, {_BRANDS}
SELECT a.author_id AS best, a.outbound_messages AS best_outbound, b.author_id AS runner_up,
  b.outbound_messages AS runner_up_outbound,
  round(a.outbound_messages * 100.0::DOUBLE / (SELECT count(*) FROM msgs), 6) AS best_pct
FROM ranked_brands a, ranked_brands b WHERE a.rank = 1 AND b.rank = 2""",
    "reply_fill_counts": f"""WITH {FULL}
SELECT count(in_response_to_tweet_id) AS are_replies, count(response_tweet_id) AS got_reply
FROM full_msgs""",
    "quality_flags": f"""WITH {DIRTY}
SELECT 'duplicate_id_rows' AS flag, (count(*) - count(DISTINCT tweet_id))::DOUBLE AS value
FROM dirty HAVING count(*) > count(DISTINCT tweet_id)
UNION ALL SELECT 'direction_unknown', count(*)::DOUBLE FROM dirty WHERE inbound IS NULL
  HAVING count(*) > 0
UNION ALL SELECT 'sparse_column:in_response_to_tweet_id',
  round(count(*) FILTER (in_response_to_tweet_id IS NULL) * 100.0::DOUBLE / count(*), 6) FROM dirty
  HAVING count(*) FILTER (in_response_to_tweet_id IS NULL) * 2 > count(*)""",
    "extraction_ledger": f"""WITH {CLEAN},
b AS (SELECT count(*) AS n, count(DISTINCT conversation_id) AS c FROM dpairs),
a AS (SELECT count(*) AS n, count(DISTINCT conversation_id) AS c FROM clean)
SELECT (SELECT count(*) FROM msgs) AS extracted,
  (SELECT count(*) FROM msgs WHERE author_id = '{BRAND}') AS outbound,
  (SELECT count(*) FROM msgs WHERE author_id <> '{BRAND}') AS customer,
  b.n AS pairs_before, a.n AS pairs_after, b.c AS conversations_before,
  a.c AS conversations_after, b.n - a.n AS pairs_removed,
  round((b.n - a.n) * 100.0::DOUBLE / b.n, 6) AS removed_pct FROM a, b""",
    "turn_stats": f"""WITH {CLEAN}
SELECT count(*) AS conversations, round(avg(turns), 6) AS avg_turns,
  quantile_cont(turns, 0.5) AS median_turns, min(turns) AS min_turns, max(turns) AS max_turns,
  count(*) FILTER (turns = 1) AS single_turn, count(*) FILTER (turns >= 2) AS multi_turn,
  round(count(*) FILTER (turns = 1) * 100.0::DOUBLE / count(*), 6) AS single_pct,
  round(count(*) FILTER (turns >= 2) * 100.0::DOUBLE / count(*), 6) AS multi_pct FROM conv_lengths""",
    "length_stats": f"WITH {CLEAN} {_STATS}",
    "date_range": f"""WITH {MESSAGES}, t AS (SELECT try_strptime(created_at, '%Y-%m-%d %H:%M:%S') AS ts FROM msgs)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS earliest,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, count(*) FILTER (ts IS NULL) AS unparsed FROM t""",
    "date_range_mixed": f"""WITH {MESSAGES}, t AS (SELECT try_strptime(created_at, '%Y-%m-%d %H:%M:%S') AS ts FROM msgs)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS earliest,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, count(*) FILTER (ts IS NULL) AS unparsed FROM t""",
    "conversation_stats": f"""WITH {CLEAN}
SELECT conversation_id, max(turn_index) AS n_turns,
  arg_min(customer_text, turn_index) AS first_customer_text,
  arg_min(support_text, turn_index) AS first_support_text,
  CAST(sum(length(customer_text)) AS BIGINT) AS total_customer_chars,
  CAST(sum(length(support_text)) AS BIGINT) AS total_support_chars
FROM clean GROUP BY 1""",
    "dq_counts": f"""WITH {CLEAN}
SELECT count(*) FILTER (length(customer_text) < 5) AS short_customer_texts,
  round(count(*) FILTER (customer_text IS NULL) * 100.0::DOUBLE / count(*), 6) AS customer_null_pct,
  round(count(*) FILTER (support_text IS NULL) * 100.0::DOUBLE / count(*), 6) AS support_null_pct,
  (SELECT count(*) FROM conv_lengths WHERE turns >= 3) AS long_conversations FROM clean""",
    "longest_conversations": f"""WITH {CLEAN}
SELECT conversation_id, turns FROM conv_lengths WHERE turns >= 2
ORDER BY turns DESC, conversation_id LIMIT 5""",
    "sample_conversations": f"""WITH {CLEAN},
chosen AS (
  (SELECT conversation_id, 'single' AS kind FROM conv_lengths WHERE turns = 1
   ORDER BY conversation_id LIMIT 2)
  UNION ALL
  (SELECT conversation_id, 'multi' FROM conv_lengths WHERE turns >= 2
   ORDER BY conversation_id LIMIT 2))
SELECT kind, conversation_id, turn_index,
  substr({strip("replace(customer_text, chr(10), ' ')")}, 1, 300) AS customer_text,
  substr({strip("replace(support_text, chr(10), ' ')")}, 1, 300) AS support_text
FROM clean JOIN chosen USING (conversation_id)""",
    "parse_ids": f"""WITH {MESSAGES}
SELECT tweet_id, CASE WHEN turn % 3 = 2 THEN NULL ELSE in_response_to_tweet_id END AS parent_id
FROM msgs""",
    "schema_peek": """SELECT * FROM (VALUES (1::BIGINT, 'tweet_id', 'bigint'), (2, 'author_id', 'string'),
  (3, 'inbound', 'boolean'), (4, 'created_at', 'string'), (5, 'text', 'string'),
  (6, 'response_tweet_id', 'bigint'), (7, 'in_response_to_tweet_id', 'bigint'))
  t(position, "column", type)""",
    "csv_scan": f"WITH {FULL} SELECT * FROM full_msgs",
    "clean_text": f"WITH {CLEANED} SELECT doc_id, clean_text FROM cleaned",
    "display_text": f"""SELECT conv_id * 1000 + turn + 1 AS tweet_id,
  substr({strip("replace(text, chr(10), ' ')")}, 1, 300) AS report_line,
  substr(replace(text, chr(10), ' '), 1, 150) AS console_line FROM conversations""",
    "word_topk": f"""WITH words AS (
  SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
SELECT word, count(*) AS n FROM words
WHERE length(word) > 2 AND word NOT IN ({REPORT_STOPS})
GROUP BY word ORDER BY n DESC, word LIMIT 25""",
    "bigram_topk": top_grams(2),
    "trigram_topk": top_grams(3),
    "doc_freq": f"WITH {TRAIN_TERMS} SELECT term, df, cf FROM vocab ORDER BY cf DESC, term LIMIT 2000",
    "tfidf": f"""WITH {CLEANED},
terms AS (SELECT doc_id, unnest(w) AS term FROM topic_words),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
vocab AS (
  SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 2000),
{weights('vocab', 'tf')}""",
    "tfidf_sublinear": f"""WITH {TRAIN_TERMS},
best AS (SELECT term, df FROM vocab ORDER BY cf DESC, term LIMIT 50000),
{weights('best', '(1 + ln(tf))')}""",
    "weak_label": f"""WITH {WEAK}
SELECT customer_tweet_id, customer_text, intent, confidence, labeling_method FROM weak""",
    "auto_label": f"""WITH {GOLDEN}
SELECT customer_tweet_id, intent, difficulty, labeling_notes FROM auto""",
    "keyword_baseline": f"WITH {SPIKED} SELECT customer_tweet_id, {KEYWORD_CASE} AS intent FROM spiked",
    "majority_baseline": f"""WITH {WEAK}
SELECT intent AS majority_class, count(*) AS n FROM weak GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1""",
    "expected_escalation": f"""WITH {PREDS}
SELECT customer_tweet_id, true_intent, expected_escalation::BIGINT AS expected_escalation FROM preds""",
    "override_route": f"""WITH {ROUTED}
SELECT customer_tweet_id, model_intent, intent, override_reason FROM routed""",
    "escalation_reason": f"""WITH {ROUTED}
SELECT customer_tweet_id, intent, confidence, needs_escalation, escalation_reason FROM decided""",
    "confidence_flags": f"""WITH {ROUTED}
SELECT CASE WHEN confidence < 0.6 THEN 'low' ELSE 'ok' END AS confidence_flag, count(*) AS n
FROM decided GROUP BY 1""",
    "uniform_sample": """SELECT doc_id, source, n_chars FROM documents
ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""",
    "quota_sample": """WITH r AS (
  SELECT event_id, user_id, value, row_number() OVER (
    ORDER BY md5('42:' || CAST(event_id AS VARCHAR)), event_id) AS nth FROM events)
SELECT event_id, user_id, value FROM r WHERE nth <= (SELECT count(*) // 2 FROM events)""",
    "length_bins": f"""WITH {GOLD_DOCS}
SELECT doc_id AS customer_tweet_id, text_len, len_bin FROM binned""",
    "golden_sample": f"WITH {GOLD_DOCS} SELECT * FROM gold",
    "golden_bin_counts": f"WITH {GOLD_DOCS} SELECT len_bin, count(*) AS n FROM gold GROUP BY 1",
    "undersample": f"""WITH {WEAK}, {balanced('weak')}
SELECT customer_tweet_id, intent FROM balanced""",
    "train_val_split": f"""WITH {WEAK}, {split('weak')}
SELECT customer_tweet_id, intent, split FROM split_rows""",
    "prepare_training": f"""WITH {WEAK}, {HELD_OUT},
usable AS (
  SELECT * FROM weak WHERE customer_text IS NOT NULL AND confidence >= 0.5
    AND customer_tweet_id NOT IN (SELECT customer_tweet_id FROM held)),
{balanced('usable')}, {split('balanced')}
SELECT customer_tweet_id, intent, confidence, split FROM split_rows""",
    "row_count_gate": """SELECT least(count(*), 250)::BIGINT AS n_rows, count(*) >= 250 AS ok
FROM documents""",
    "class_weights": f"""WITH {WEAK}, c AS (SELECT intent, count(*) AS support FROM weak GROUP BY 1)
SELECT intent, support, round((SELECT sum(support) FROM c)::DOUBLE
  / ((SELECT count(*) FROM c) * support), 6) AS weight FROM c""",
    "leakage_check": f"""WITH {WEAK}, {HELD_OUT}
SELECT customer_tweet_id, intent FROM weak
WHERE customer_tweet_id IN (SELECT customer_tweet_id FROM held)
   OR {strip('lower(customer_text)')} IN (SELECT {strip('lower(customer_text)')} FROM held)""",
    "score_given_model": given_score(),
    "validate_golden": f"""WITH {WEAK}, {AUTO}, t AS (
  SELECT count(*) AS n, count(*) - count(DISTINCT example_id) AS dup,
    count(*) FILTER (customer_text IS NULL) AS missing,
    count(DISTINCT intent) FILTER (intent NOT IN (SELECT intent FROM weak)
      AND intent <> 'UNLABELED') AS invalid,
    count(*) FILTER (intent = 'UNLABELED') AS open FROM auto)
SELECT 1::BIGINT AS check_no, 'row_count' AS check_name, n BETWEEN 150 AND 250 AS ok,
  CASE WHEN n BETWEEN 150 AND 250 THEN 0 ELSE n END AS bad FROM t
UNION ALL SELECT 2, 'duplicate_ids', dup = 0, dup FROM t
UNION ALL SELECT 3, 'missing_text', missing = 0, missing FROM t
UNION ALL SELECT 4, 'invalid_intents', invalid = 0, invalid FROM t
UNION ALL SELECT 5, 'all_labeled', open = 0, open FROM t""",
    "intent_distribution": f"""WITH {GOLDEN}
SELECT intent, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct
FROM auto GROUP BY 1""",
    "difficulty_distribution": f"""WITH {GOLDEN}
SELECT difficulty, count(*) AS n FROM auto GROUP BY 1""",
    "route_model": ROUTE_SQL.replace(ROUTED, ROUTED_GIVEN, 1),
    "route_stream_model": ROUTE_SQL.replace(ROUTED, ROUTED_GIVEN, 1),
    "model_round_trip": f"""WITH {SPIKED}, {GIVEN}
SELECT customer_tweet_id, model_intent, round(full_confidence, 6) AS confidence FROM scored""",
    "training_gradient": GRADIENT,
    "training_optimum": f"""WITH {WEAK},
w AS (
  SELECT customer_tweet_id, regexp_extract_all(lower(customer_text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w
  FROM weak WHERE customer_text IS NOT NULL),
terms AS (SELECT customer_tweet_id, unnest(list_concat(w, {gram(2)})) AS term FROM w),
vocab AS (SELECT term FROM terms GROUP BY term HAVING count(DISTINCT customer_tweet_id) >= 2)
SELECT count(*) AS n_rows, count(DISTINCT intent) AS n_labels,
  (SELECT least(count(*), 50000) FROM vocab) AS n_terms, TRUE AS at_optimum
FROM weak WHERE customer_text IS NOT NULL""",
    "golden_evaluation_given": f"""WITH {ROUTED_GIVEN}, {AUTO}, {HELD_OUT},
named AS (
  SELECT a.intent AS true_intent, d.intent AS predicted_intent
  FROM decided d JOIN auto a USING (customer_tweet_id)
  WHERE customer_tweet_id IN (SELECT customer_tweet_id FROM held)), {report('predicted_intent')}
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
  support FROM rep""",
    "cluster_assign_given": f"WITH {LLOYD} SELECT doc_id, cluster FROM assigned",
    "cluster_profile_given": f"""WITH {LLOYD},
sizes AS (SELECT cluster, count(*) AS size FROM assigned GROUP BY 1),
centres AS (
  SELECT cluster, term, round(sum(x) / any_value(size), 9) AS w
  FROM x JOIN assigned USING (doc_id) JOIN sizes USING (cluster) GROUP BY ALL),
words AS (
  SELECT cluster, string_agg(term, ', ' ORDER BY w DESC, term) AS words FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY w DESC, term) AS nth FROM centres)
  WHERE nth <= 5 GROUP BY 1),
examples AS (
  SELECT cluster, text, row_number() OVER (PARTITION BY cluster
    ORDER BY NOT (length(clean_text) BETWEEN 31 AND 149), doc_id) AS nth
  FROM cleaned JOIN assigned USING (doc_id))
SELECT cluster, size, words, substr(replace(text, chr(10), ' '), 1, 200) AS example
FROM sizes LEFT JOIN words USING (cluster) JOIN examples USING (cluster) WHERE nth = 1""",
    "taxonomy": f"""WITH {WEAK}
SELECT (row_number() OVER (ORDER BY intent) - 1)::INTEGER AS position, intent AS name
FROM (SELECT DISTINCT intent FROM weak)""",
    "csv_rejects": f"""WITH {MESSAGES}
SELECT tweet_id, 9::BIGINT AS n_fields, 'too many fields: 9 instead of 7' AS reason,
  TRUE AS has_file FROM msgs WHERE tweet_id % 5 = 3""",
    "missing_columns": f"""WITH {MESSAGES}
SELECT 'response_tweet_id' AS "column" FROM (SELECT count(*) AS n FROM msgs) WHERE n >= 0""",
    "ordered_export": f"""WITH {MESSAGES}
SELECT row_number() OVER (ORDER BY tweet_id) AS row_no, tweet_id FROM msgs""",
    "profile_incremental": f"""WITH {DIRTY},
ids AS (SELECT tweet_id, count(*) AS n FROM dirty WHERE tweet_id IS NOT NULL GROUP BY 1)
""" + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'n_rows' AS measure, count(*)::BIGINT AS value FROM dirty
UNION ALL SELECT '{c}', 'n_null', count(*) FILTER ({c} IS NULL) FROM dirty"""
        for c in ("tweet_id", "author_id", "inbound", "created_at", "text", "in_response_to_tweet_id")
    ) + """
UNION ALL SELECT 'tweet_id', 'unique_ids', count(*) FROM ids
UNION ALL SELECT 'tweet_id', 'duplicated_ids', count(*) FILTER (n > 1) FROM ids
UNION ALL SELECT 'tweet_id', 'extra_rows', sum(n - 1)::BIGINT FROM ids""",
    "distinct_estimates": f"WITH {DIRTY} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS exact, TRUE AS within_5_pct FROM dirty"""
        for c in ("tweet_id", "author_id", "inbound", "created_at", "text", "in_response_to_tweet_id")
    ),
    "review_queue": f"""WITH {REVIEW}
SELECT a.example_id, a.customer_text, a.intent AS current_intent, f.suggested_intent,
  f.reason_for_review, '' AS human_decision, '' AS final_intent
FROM auto a JOIN flags f USING (example_id) WHERE f.reason_for_review <> ''""",
    "review_gate": f"""WITH {REVIEW}
SELECT count(*) FILTER (human_decision = '' OR suggested_intent IS NULL) AS open_rows,
  count(*) FILTER (human_decision = '' OR suggested_intent IS NULL) = 0 AS ok FROM flags""",
    "apply_review": f"""WITH {REVIEW},
acc AS (SELECT example_id, suggested_intent FROM flags
  WHERE {strip('lower(human_decision)')} = 'accept')
SELECT a.example_id, coalesce(acc.suggested_intent, a.intent) AS intent,
  CASE WHEN acc.example_id IS NULL THEN a.difficulty ELSE 'medium' END AS difficulty,
  CASE WHEN acc.example_id IS NULL THEN a.labeling_notes ELSE {lit(packs.NOTE_REVIEWED)} END
    AS labeling_notes,
  acc.example_id IS NOT NULL AS corrected
FROM auto a LEFT JOIN acc USING (example_id)""",
    "accuracy": f"""WITH {PREDS}
SELECT count(*) AS n, count(*) FILTER (correct) AS correct,
  round(avg(correct::INTEGER), 9) AS accuracy FROM preds""",
    "class_report": f"""WITH {NAMED}, {report('predicted_intent')}
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
  support FROM rep""",
    "macro_weighted": f"""WITH {NAMED}, {report('predicted_intent')}
SELECT 'macro' AS average, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall,
  round(avg(f1), 9) AS f1 FROM rep
UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 9),
  round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9) FROM rep""",
    "binary_escalation": f"""WITH {PREDS}, c AS (
  SELECT count(*) FILTER (expected_escalation = 1 AND predicted_escalation = 1) AS tp,
    count(*) FILTER (expected_escalation = 0 AND predicted_escalation = 1) AS fp,
    count(*) FILTER (expected_escalation = 1 AND predicted_escalation = 0) AS fn,
    count(*) FILTER (expected_escalation = 0 AND predicted_escalation = 0) AS tn FROM preds)
SELECT *, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 9) AS accuracy,
  round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / (tp + fn), 9) AS recall,
  round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""",
    "quality_labels": """WITH c AS (
  SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp,
    count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
    count(*) FILTER (quality = 1 AND toxic = 0) AS fn,
    count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels)
SELECT *, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 9) AS accuracy,
  coalesce(round(tp::DOUBLE / nullif(tp + fp, 0), 9), 0) AS precision,
  coalesce(round(tp::DOUBLE / nullif(tp + fn, 0), 9), 0) AS recall,
  coalesce(round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 9), 0) AS f1 FROM c""",
    "escalation_totals": f"""WITH {PREDS}
SELECT expected_escalation::BIGINT AS expected_escalation, count(*) AS n FROM preds GROUP BY 1""",
    "confusion_matrix": f"""WITH {PREDS}, {DIM}
SELECT t.d_intent AS true_intent, p.d_intent AS predicted_intent, count(preds.example_id) AS n
FROM dim t CROSS JOIN dim p LEFT JOIN preds
  ON preds.true_intent = t.d_intent AND preds.predicted_intent = p.d_intent GROUP BY 1, 2""",
    "confusion_wide": f"""WITH {PREDS} SELECT true_intent, {', '.join(
        f"count(*) FILTER (predicted_intent = {lit(i)}) AS {i}" for i in packs.ALL_INTENTS)}
FROM preds GROUP BY 1""",
    "confusion_pairs": f"""WITH {PREDS}
SELECT true_intent, predicted_intent, count(*) AS n FROM preds WHERE NOT correct
GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10""",
    "error_marginals": f"""WITH {PREDS}
SELECT 'true' AS side, true_intent AS intent, count(*) AS n FROM preds WHERE NOT correct GROUP BY 2
UNION ALL SELECT 'predicted', predicted_intent, count(*) FROM preds WHERE NOT correct GROUP BY 2""",
    "failure_rows": f"""WITH {PREDS}
SELECT example_id, customer_text AS input_ticket, true_intent AS expected_output,
  predicted_intent AS actual_output,
  CASE WHEN predicted_intent <> 'other_unknown' AND confidence < 0.6
    THEN {lit(packs.FAILURE_LOW)} ELSE {lit(packs.FAILURE_WRONG)} END AS failure_category,
  CASE WHEN predicted_intent = 'other_unknown' THEN {lit(packs.FAILURE_REASON_OTHER)}
    ELSE {lit(packs.FAILURE_REASON)} END AS possible_reason,
  CASE WHEN predicted_intent = 'other_unknown' THEN {lit(packs.FAILURE_FIX_OTHER)}
    ELSE {lit(packs.FAILURE_FIX)} END AS suggested_improvement
FROM preds WHERE NOT correct""",
    "error_samples": f"""WITH {PREDS}
SELECT example_id, customer_text, true_intent, predicted_intent, confidence FROM preds
WHERE NOT correct ORDER BY example_id LIMIT 15""",
    "accuracy_gaps": f"""WITH {PATCHY}
SELECT count(*) AS n, count(*) FILTER (true_intent = predicted_intent) AS correct,
  round(count(*) FILTER (true_intent = predicted_intent) / count(*)::DOUBLE, 9) AS accuracy FROM patchy""",
    "binary_gaps": f"""WITH {PATCHY}, c AS (
  SELECT count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp,
    count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn
  FROM (SELECT expected_escalation = 1 AS e, coalesce(predicted_escalation, 0) = 1 AS p FROM patchy))
SELECT *, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 9) AS accuracy,
  round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / (tp + fn), 9) AS recall,
  round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""",
    "confusion_pairs_gaps": f"""WITH {PATCHY}
SELECT true_intent, predicted_intent, count(*) AS n FROM patchy
WHERE true_intent IS DISTINCT FROM predicted_intent
GROUP BY 1, 2 ORDER BY n DESC, 1 NULLS FIRST, 2 NULLS FIRST LIMIT 10""",
    "error_marginals_gaps": f"""WITH {PATCHY}, wrong AS (
  SELECT * FROM patchy WHERE true_intent IS DISTINCT FROM predicted_intent)
SELECT 'true' AS side, true_intent AS intent, count(*) AS n FROM wrong GROUP BY 2
UNION ALL SELECT 'predicted', predicted_intent, count(*) FROM wrong GROUP BY 2""",
    "failure_rows_gaps": f"""WITH {PATCHY}
SELECT example_id, customer_text AS input_ticket, true_intent AS expected_output,
  predicted_intent AS actual_output,
  CASE WHEN predicted_intent <> 'other_unknown' AND confidence < 0.6
    THEN {lit(packs.FAILURE_LOW)} ELSE {lit(packs.FAILURE_WRONG)} END AS failure_category,
  CASE WHEN predicted_intent = 'other_unknown' THEN {lit(packs.FAILURE_REASON_OTHER)}
    ELSE {lit(packs.FAILURE_REASON)} END AS possible_reason,
  CASE WHEN predicted_intent = 'other_unknown' THEN {lit(packs.FAILURE_FIX_OTHER)}
    ELSE {lit(packs.FAILURE_FIX)} END AS suggested_improvement
FROM patchy WHERE true_intent IS DISTINCT FROM predicted_intent""",
    "report_table": f"""WITH {NAMED}, {report('predicted_intent')}
SELECT label, round(precision, 2) AS precision, round(recall, 2) AS recall, round(f1, 2) AS f1,
  support FROM rep""",
    "model_comparison": f"""WITH {MODEL_ROWS}, {report('maj', 'r1')}, {report('keyword', 'r2')},
{report('predicted_intent', 'r3')}
{' UNION ALL '.join(model_row(n, f'r{i}') for i, n in enumerate(packs.MODEL_NAMES, 1))}""",
    "metrics_json": f"""WITH {NAMED}, {report('predicted_intent')}
SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM rep""",
    "route_batch": ROUTE_SQL,
    "route_stream": ROUTE_SQL,
    "reply_template": f"""WITH {ROUTED}, {DIM}
SELECT customer_tweet_id, intent, label, priority, department, action, evidence, reply,
  {lit(packs.REPLY_MODE)} AS reply_mode FROM {dimmed('decided', 'intent')}""",
    "prompt_text": f"""WITH {ROUTED}, {DIM}
SELECT customer_tweet_id, {prompt(packs.REPLY_PROMPT, message='customer_text', evidence='evidence')}
  AS prompt FROM {dimmed('decided', 'intent')}""",
    "judge_prompt": f"""WITH {PREDS}, {DIM}
SELECT customer_tweet_id, {prompt(packs.JUDGE_PROMPT, message='customer_text',
    predicted='predicted_intent', expected='true_intent', evidence='evidence', reply='reply')}
  AS prompt FROM {dimmed('preds', 'predicted_intent')}""",
    "judge_scores": f"WITH {JUDGED} SELECT * FROM judge",
    "judge_summary": f"""WITH {JUDGED} SELECT count(*) AS examples, {', '.join(
        f"round(avg(judge_{s}_score), 6) AS avg_{s}_score"
        for s in ('intent', 'relevance', 'grounding', 'helpfulness', 'safety', 'overall'))} FROM judge""",
    "human_template": f"""WITH {JUDGED}
SELECT example_id, customer_message, generated_reply, '' AS human_overall_score,
  '' AS human_grounding_score, '' AS human_helpfulness_score, '' AS human_safety_score,
  '' AS human_comments FROM judge""",
    "judge_all": f"""WITH {JUDGE_ALL}
SELECT example_id, judge_intent_score, judge_relevance_score, judge_grounding_score,
  judge_helpfulness_score, judge_safety_score, judge_overall_score FROM judge""",
    "ratings_pending": """SELECT count(*) FILTER ((conv_id + turn * 3) % 6 > 0) AS rated,
  count(*) FILTER ((conv_id + turn * 3) % 6 > 0) = 0 AS pending FROM conversations""",
    "rater_agreement": f"""WITH {JUDGE_ALL},
rated AS (
  SELECT j.judge_overall_score::DOUBLE AS j, ((s.conv_id + s.turn * 3) % 6)::DOUBLE AS h
  FROM judge j JOIN spiked s USING (example_id) WHERE (s.conv_id + s.turn * 3) % 6 > 0)
SELECT count(*) AS rated, round(avg((j = h)::INTEGER) * 100, 6) AS exact_pct,
  round(avg((abs(j - h) <= 1)::INTEGER) * 100, 6) AS within_one_pct,
  round(avg(abs(j - h)), 6) AS mean_abs_diff, round(corr(j, h), 6) AS pearson FROM rated""",
    "judge_reply_parse": """SELECT conv_id * 1000 + turn + 1 AS tweet_id,
  CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id % 5 + 1 END AS judge_intent_score,
  CASE WHEN conv_id % 3 = 0 THEN 0 ELSE turn % 5 + 1 END AS judge_relevance_score,
  CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 4 END::BIGINT AS judge_grounding_score,
  CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 3 END::BIGINT AS judge_helpfulness_score,
  5::BIGINT AS judge_safety_score,
  CASE WHEN conv_id % 3 = 0 THEN 0 ELSE (conv_id + turn) % 5 + 1 END AS judge_overall_score,
  CASE WHEN conv_id % 3 = 0 THEN '' ELSE text END AS judge_reason FROM conversations""",
}

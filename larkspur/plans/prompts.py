"""Prompt templates, in our own words. Placeholders are filled in turn; unknown ones stay."""

ASSISTANT = """You help a person whose profile and present state you know.
Profile: {summary}
State: {state}
So far:
{history}"""

ASSISTANT_PROFILE = """You help a person whose profile you know.
Profile: {summary}
So far:
{history}"""

USER = """Speak as the person described here and keep a report of your state.
Profile: {summary}
State before: {state}
{block}"""

USER_PLAIN = """Speak as the person described here.
Profile: {summary}
So far:
{history}"""

REMINDER = "Turn {turn} of {turns}: first <user_state>, then <message>, in the person's own voice."

CONTROLLER = """Choose how the person goes on, by the number of a behaviour, as JSON.
Profile: {summary}
State: {state}
So far:
{history}
Earlier choices: {earlier}
Turn {turn} of {turns}"""

FIRST_STATE = """# User State Report
Turn: 1, a new session.
Goal: {intent}
Short-term intent: {intent}
Nothing has been answered yet."""

JUDGE_CONSISTENCY = """Rate from 1 to 5 how well the user's messages fit the profile; answer as JSON with score and reason.
Profile: {summary}
Conversation:
{history}"""

JUDGE_CONFLICT = """Say whether a user message contradicts the profile; answer as JSON with label (no_contradiction, contradicts, unclear) and offending_turn.
Profile: {summary}
Conversation:
{history}"""

QUESTION = {
    "personamem_mcq": """Write a question that this person would ask next, the answer that fits them, and a stereotypical, a random and a generic one, as JSON.
Profile: {summary}
State: {state}
Conversation:
{history}""",
    "prefeval_gen": """Write a preference of this person, a question that touches it, a response that follows it and a quote of the response that shows so, as JSON.
Profile: {summary}
Conversation:
{history}""",
    "lamp_cls": """Write past items of this person (input, output), a new query and its target, as JSON with task_family.
Profile: {summary}
Conversation:
{history}""",
}

REASONING = """Explain step by step why the answer {letter} fits best, and end with: {final}
Conversation:
{history}
{question}"""

ADHERENCE = {
    "acknow": "Does the response take up a preference? Answer in <answer>, name it in <preference>.\nQuestion: {question}\nResponse: {end_generation}",
    "violate": "Does the response break this preference? Answer in <answer>.\nPreference: {preference}\nQuestion: {question}\nResponse: {end_generation}",
    "hallucinate": "Does the restated preference differ from the real one? Answer in <answer>.\nPreference: {preference}\nRestated: {assistant_restatement}",
    "helpful": "Does the response help? Answer in <answer>.\nQuestion: {question}\nResponse: {end_generation}",
}

SCENARIOS = """Write {family} scenarios in which this person would turn to an assistant, as a JSON array of objects with scenario_id, category, initial_prompt and context_note.
Profile: {summary}"""

ADHERENCE_SYSTEM = "You answer helpfully."
ADHERENCE_JUDGE = "You judge an assistant's answer. Be strict and fair, and reply in the form that is asked for."
# What a task adds to the question.
ADHERENCE_HINTS = {
    "zero-shot": "",
    "remind": "\n\nThink of what I told you I like before you answer.",
    "cot": "\n\nFirst go through what you know of my preferences, step by step; then answer.",
}

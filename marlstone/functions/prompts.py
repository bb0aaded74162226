"""Prompt templates and chat messages. Wording is our own; only marks and placeholders carry meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EXAMPLES_END, EXAMPLES_MARK, FAILURE_MARK, bullets, fill

_SHOTS = f"{EXAMPLES_MARK}\n{{examples}}\n{EXAMPLES_END}\n\n"

SUMMARY = "Collect the key facts about {ticker} from these posts.\n" + _SHOTS + "Posts:\n{tweets}\n\nFacts:"
SUMMARY_CONCISE = (
    "Write a short list of facts about {ticker} from today's posts. Leave out opinions and guesses.\n" + _SHOTS + "Posts:\n{tweets}\n\nSummary:"
)
NEWS = "Condense this raw news text about {ticker}. Answer with Summary: ..., Keywords: ..., or N/A if nothing applies.\nNews: {news}\n"
PREDICT = (
    "Judge how these facts move the price of {ticker}. Answer with (1) Price Movement, Positive or Negative, and (2) Explanation, one paragraph.\n"
    + _SHOTS
    + "Facts:\n{summary}\n\nPrice Movement:"
)
PREDICT_REFLECT = PREDICT.replace("Facts:\n", "{reflections}\n\nFacts:\n")
REFLECTION_HEADER = f"{FAILURE_MARK} These notes say what went wrong; use them.\n"
REFLECT = "You judged {ticker} wrongly. Say briefly why and how to do better.\n\nPrevious trial:\n{scratchpad}\n\nReflection:"
COMPANY = "Describe the company behind {ticker} in keywords. Say in one line what it does, then what helps its price and what hurts it.\n"
SIMILAR = "Name the 3 stocks most similar to {ticker}."
FORECAST_SYSTEM = "Forecast the next day's return of a stock from its company profile and recent news.\n"
FORECAST_USER = (
    "About the company: {company_description}\n\nWhat was said lately:\n{summary}\n\n"
    "Forecast the next day. Use the format Summary: ..., Keywords: ..., Stock Return: [number]% ([up/down])\n"
)
#: An earlier sample and how it turned out.
EXAMPLE = "News:\n{summary}\nOutcome: {target}"
FORECAST_USER_SHOTS = FORECAST_USER.replace("Forecast the next", "Examples: {few_shot_learning_examples}\n\nForecast the next")
SUMMARY_EXAMPLES = "Posts:\nOrders at the plant rose by a fifth, says its manager.\nLovely weather today!\n\nFacts:\n- Orders rose by a fifth."
EXAMPLES = "Facts:\nOrders rose by a fifth.\n\nPrice Movement: Positive\nExplanation: More orders mean more sales."
FACTS_BLOCK = "Facts:\n{summary}\n\nPrice Movement: "
INSTRUCT = "Answer the instruction below.\n\n### Instruction:\n{instruction}\n\n### Response:\n"
INSTRUCT_INPUT = "Answer the instruction below; the input gives its context.\n\n### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n"
QUESTION = "Question: {question}\n\nAnswer: "


def predict_prompt(ticker: Column, summary: Column, reflections: Column | None = None, examples: str = EXAMPLES) -> Column:
    """The prediction prompt; with ``reflections`` (text) the one that shows them."""
    values = {"ticker": ticker, "summary": summary, "examples": F.lit(examples)}
    return fill(PREDICT, values) if reflections is None else fill(PREDICT_REFLECT, values | {"reflections": reflections})


def reflections_text(items: Column) -> Column:
    return bullets(items, REFLECTION_HEADER)


def messages(system: Column, user: Column) -> Column:
    """A chat of a system and a user message."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", system), turn("user", user))


def instruct(instruction: Column, input_: Column, output: Column | None = None) -> Column:
    """The instruction prompt, with its input if not empty, followed by ``output`` if given."""
    values = {"instruction": instruction, "input": F.coalesce(input_, F.lit(""))}
    prompt = F.when(values["input"] != "", fill(INSTRUCT_INPUT, values)).otherwise(fill(INSTRUCT, values))
    return prompt if output is None else F.concat(prompt, output)


def question_answer(question: Column, answer: Column | None = None) -> Column:
    prompt = fill(QUESTION, {"question": question})
    return prompt if answer is None else F.concat(prompt, answer)

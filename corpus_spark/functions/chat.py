"""Chat records: building, unpacking and rendering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from corpus_spark.functions.text import strip_prefix

# The prompt texts models were trained with.
SYSTEM_PROMPT = (
    "You are an expert translator of Old Assyrian Akkadian cuneiform texts into English. "
    "Determinatives in curly brackets classify nouns: {d} = deity, {ki} = place, {m} = masculine name, "
    "{mi} = feminine name. Words in ALL CAPS are Sumerian logograms. Words with a capitalized first letter "
    "are proper nouns. Translate the transliterated Akkadian into fluent English."
)
USER_PREFIX = "Translate: "

MESSAGE_SCHEMA = StructType([StructField("role", StringType()), StructField("content", StringType())])
CHAT_SCHEMA = StructType([StructField("messages", ArrayType(MESSAGE_SCHEMA))])


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_messages(source: Column, system_prompt: str = SYSTEM_PROMPT) -> Column:
    """System and user message, for inference. A null source gives null messages."""
    messages = F.array(
        _message("system", F.lit(system_prompt)),
        _message("user", F.concat(F.lit(USER_PREFIX), source)),
    )
    return F.when(source.isNotNull(), messages)


def chat_messages(source: Column, target: Column, system_prompt: str = SYSTEM_PROMPT) -> Column:
    """System, user and assistant message, for training. A null text gives null messages, not a
    message without content."""
    messages = F.array(
        _message("system", F.lit(system_prompt)),
        _message("user", F.concat(F.lit(USER_PREFIX), source)),
        _message("assistant", target),
    )
    return F.when(source.isNotNull() & target.isNotNull(), messages)


def message_source(messages: Column) -> Column:
    """The user text without its prefix."""
    return strip_prefix(F.get(messages, F.lit(1))["content"], USER_PREFIX)


def message_reference(messages: Column) -> Column:
    """The assistant text."""
    return F.get(messages, F.lit(2))["content"]


@dataclass(frozen=True)
class ChatTemplate:
    """How messages become one prompt string. The defaults are the common ChatML layout with an
    empty thinking block in the generation suffix, which turns thinking off."""

    message_start: str = "<|im_start|>"
    role_end: str = "\n"
    message_end: str = "<|im_end|>\n"
    generation: str = "<|im_start|>assistant\n<think>\n\n</think>\n\n"

    def render(self, messages: Column, add_generation_prompt: bool = True) -> Column:
        body = F.array_join(
            F.transform(
                messages,
                lambda message: F.concat(
                    F.lit(self.message_start), message["role"], F.lit(self.role_end),
                    message["content"], F.lit(self.message_end),
                ),
            ),
            "",
        )
        return F.concat(body, F.lit(self.generation)) if add_generation_prompt else body

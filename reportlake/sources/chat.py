"""A client of a chat model, for back-filling; needs the optional openai package and its key."""

from __future__ import annotations

import os
from collections.abc import Callable


def chat_client(model: str, *, max_tokens: int = 300, temperature: float = 0.0, key: str = "OPENAI_API_KEY", make: Callable | None = None) -> Callable[[list[dict]], str | None]:
    """Answers messages by a model; without a key it answers nothing. make: gives a client for a key, else the package's own."""
    held: list = []

    def answer(messages: list[dict]) -> str | None:
        if not os.environ.get(key):
            return None
        if not held:  # once a process
            if make is None:
                from openai import OpenAI

                held.append(OpenAI(api_key=os.environ[key]))
            else:
                held.append(make(os.environ[key]))
        done = held[0].chat.completions.create(model=model, messages=messages, temperature=temperature, max_tokens=max_tokens)
        return done.choices[0].message.content

    return answer

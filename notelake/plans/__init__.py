"""Registered queries: operators bound to tables, each with its SQL oracle."""

from . import audits, decisions, delivery, events, facts, mail, notices, observations, pages, quality, questions, responses, rules, search, streams  # noqa: F401

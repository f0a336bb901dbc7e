"""Conversation-risk analytics as Spark DataFrame operators."""

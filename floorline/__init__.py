"""Conversation-floor analytics on Spark: who holds the floor, for how long, and how sure we are."""

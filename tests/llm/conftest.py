"""The operators here are optional: without them there is nothing to collect."""

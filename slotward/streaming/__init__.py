"""The gold join as a Structured Streaming job."""

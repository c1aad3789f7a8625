"""DataFrame operators of transcript scoring, statistics, timelines and corpus building."""

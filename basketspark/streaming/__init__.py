"""Activity as streams: counters, cooldowns, rate limits, clicks and shared state."""

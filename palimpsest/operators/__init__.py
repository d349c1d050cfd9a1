"""Pure DataFrame operators over version logs, runs and transactions."""

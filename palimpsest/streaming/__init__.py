"""From streams into the store."""

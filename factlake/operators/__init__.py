"""What builds, changes, checks and maintains result sets."""

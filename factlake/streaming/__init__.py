"""Result sets as streaming sinks."""

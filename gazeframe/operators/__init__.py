"""DataFrame operators over frames, fixations, tasks and edits."""

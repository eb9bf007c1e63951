"""DataFrame-to-DataFrame operators: postings, matching, ranking, changes."""

"""DataFrame operators over the tables of clips, frames, windows and tone-bearing units."""

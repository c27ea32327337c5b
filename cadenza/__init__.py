"""Music-transcription analytics on Spark: recordings, notes, windows, chords, events, keys."""

"""Schemas of the tables that the operators read and write.  Times are seconds as doubles."""

NOTES = "recording_id long, note_id long, start double, end double, pitch int, velocity int"
FRAMES = "track_id long, frame_idx long, time double, f0_hz double, confidence double"
ONSETS = "track_id long, onset_time double"
RMS = "track_id long, frame_idx long, energy double"
RAW_NOTES = "track_id long, frame_idx long, pitch int, start double, end double, velocity int, confidence double"
SEGMENTS = "recording_id long, window_idx long, start double, end double, chord string, note_count long, unique_pitches long"
CHORD_EVENTS = "recording_id long, start double, end double, chord string, play_number long, duration double, total_notes long"

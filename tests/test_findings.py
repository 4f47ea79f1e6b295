"""Each check of validation on a small dataset with one fault of its kind."""

from trajspark.operators.dataset import findings

EPISODES = "position long, episode_id long, embodiment string, language_instruction string, num_frames long, action_dim int"
FRAMES = "episode_id long, timestep long, action array<float>, state array<float>, is_terminal boolean"
IMAGES = "position long, timestep long, camera string, width int, height int, channels int, data binary"


def test_findings_of_frames_and_images(spark):
    nan, inf = float("nan"), float("-inf")
    episodes = spark.createDataFrame([(0, 0, "arm", "push", 2, 2), (1, 1, "arm", "push", 3, 2), (2, 9, "", None, 1, 2), (3, 3, "arm", "push", 0, 2)], EPISODES)
    frames = [(0, 0, [1.0, 2.0], [1.0], False), (0, 1, [1.0, 2.0], [1.0], True), (1, 1, [1.0, nan], [inf], True), (1, 0, [1.0], [1.0], False), (1, 2, None, [1.0, nan], None), (9, 0, [0.0, 0.0], None, True)]
    images = [(0, 0, "top", 2, 1, 3, b"123456"), (0, 1, "top", 2, 1, 3, b"12345"), (1, 0, "top", 1, 1, 1, None)]
    index = spark.createDataFrame([(0, 2, 2), (1, 4, 2), (2, 1, 7)], "position long, num_frames long, action_dim int")
    got = findings(episodes, spark.createDataFrame(frames, FRAMES), spark.createDataFrame(images, IMAGES), index, 5, 7)
    assert sorted(((r["position"], r["timestep"], r["check"], r["severity"]) for r in got.collect()), key=str) == sorted([
        (2, None, "id_mismatch", "warning"), (2, None, "empty_embodiment", "warning"), (2, None, "empty_task", "warning"), (None, None, "total_episodes", "error"), (None, None, "total_frames", "error"),
        (1, None, "index_num_frames", "error"), (2, None, "index_action_dim", "error"), (3, None, "missing_index", "error"), (1, 0, "action_length", "error"), (1, 2, "action_length", "error"),
        (1, 2, "state_length", "error"), (1, 1, "nonfinite_action", "warning"), (1, 1, "nonfinite_state", "warning"), (1, 2, "nonfinite_state", "warning"), (1, None, "last_not_terminal", "warning"),
        (0, 1, "image_length", "error"), (1, 0, "image_length", "error"),
    ], key=str)
    assert {r["message"] for r in got.where("check = 'nonfinite_action'").collect()} == {"action[1] is NaN"}
